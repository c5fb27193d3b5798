"""HTML functions by regular expressions, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that pages use, and what they stand for; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode(text) -> Column:
    out = _c(text)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def squeeze(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def raw_title(html) -> Column:
    return squeeze(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def title(html) -> Column:
    """The title, decoded; that of the archive's own pages counts as none."""
    t = decode(raw_title(html))
    return F.when(t.contains("Wayback Machine"), "").otherwise(t)


def headings(html) -> Column:
    """The texts of h1 to h6 in order, without tags."""
    inner = F.regexp_extract_all(_c(html), F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)
    return F.transform(inner, lambda x: squeeze(decode(F.regexp_replace(x, r"(?s)<[^>]*>", ""))))


def heading_title(html) -> Column:
    """The first heading that the title holds, else the first heading, else the title."""
    t, hs = title(html), headings(html)
    inside = F.filter(hs, lambda h: (h != "") & F.lower(t).contains(F.lower(h)))
    return F.coalesce(F.get(inside, 0), F.get(hs, 0), t)


def lang(html) -> Column:
    """The first two letters of the language that the page declares."""
    return F.lower(F.substring(F.regexp_extract(_c(html), r"""(?is)<html[^>]*\blang=["']?([A-Za-z-]+)""", 1), 1, 2))


def no_scripts(html) -> Column:
    return F.regexp_replace(_c(html), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", " ")


def text(html) -> Column:
    """All visible text, decoded, with single spaces."""
    return squeeze(decode(F.regexp_replace(no_scripts(html), r"(?s)<[^>]*>", " ")))


def body(html) -> Column:
    """The text without navigation, advertisements, head, header, footer, aside and forms."""
    main = F.regexp_replace(no_scripts(html), r"""(?is)<(nav|head|header|footer|aside|form)\b[^>]*>.*?</(nav|head|header|footer|aside|form)>|<div[^>]*class=["']?ad["']?[^>]*>.*?</div>""", " ")
    return squeeze(decode(F.regexp_replace(main, r"(?s)<[^>]*>", " ")))


def links(html) -> Column:
    """array<struct<href, anchor>> of the links with a target and a text, in order."""
    raw = F.regexp_extract_all(_c(html), F.lit(r"(?is)(<a\b[^>]*\bhref\s*=.*?</a>)"), 1)
    found = F.transform(
        raw,
        lambda a: F.struct(
            F.regexp_extract(a, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]*)""", 1).alias("href"),
            squeeze(decode(F.regexp_replace(a, r"(?s)<[^>]*>", ""))).alias("anchor"),
        ),
    )
    return F.filter(found, lambda x: (x["href"] != "") & (x["anchor"] != "") & ~x["href"].startswith("#"))


def link_density(html) -> Column:
    """Letters of anchors over letters of the visible text; 0 without text."""
    total = F.length(text(html))
    inner = F.aggregate(links(html), F.lit(0), lambda s, x: s + F.length(x["anchor"]))
    return F.when(total == 0, 0.0).otherwise(inner / total)


def canonical(html) -> Column:
    """The target of the canonical link, null without one."""
    tag = F.regexp_extract(_c(html), r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>)""", 1)
    return F.nullif(F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]*)""", 1), F.lit(""))


def base(html) -> Column:
    return F.nullif(F.regexp_extract(_c(html), r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]*)""", 1), F.lit(""))


def archive_redirect(html) -> Column:
    """Where an archive's page says that it leads: the link of its note to the impatient."""
    return F.nullif(F.regexp_extract(_c(html), r"""(?is)<p[^>]*class=["']?impatient["']?[^>]*>.*?<a[^>]*\bhref\s*=\s*["']?([^"'\s>]*)""", 1), F.lit(""))


def without_toolbar(html) -> Column:
    """Without the blocks that an archive adds to its pages."""
    return F.regexp_replace(_c(html), r"""(?is)<div[^>]*id=["']?(wm-ipp-base|donato)["']?[^>]*>.*?</div>""", "")


def publish_date(html) -> Column:
    """The first date of a time element, as a date; null without one."""
    return F.to_date(F.nullif(F.regexp_extract(_c(html), r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']?([0-9]{4}-[0-9]{2}-[0-9]{2})""", 1), F.lit("")))


def breadcrumb(html) -> Column:
    """Links of the first block whose class or id speaks of a breadcrumb."""
    block = F.regexp_extract(_c(html), r"""(?is)(<(?:ul|ol|nav|div)\b[^>]*(?:class|id)=["']?[^"'>]*breadcrumb[^"'>]*["']?[^>]*>.*?</(?:ul|ol|nav|div)>)""", 1)
    return links(block)
