"""HTML operators, titles, links and languages over pages."""

from __future__ import annotations

from mendweave.functions import html as H
from mendweave.functions import urls as U
from mendweave.operators import prep

from .common import URLS, F, literal, query, table

_DECODE = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_NOSCRIPT = r"regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g')"
TEXT = _SQUEEZE.format(_DECODE.format(rf"regexp_replace({_NOSCRIPT}, '(?s)<[^>]*>', ' ', 'g')"))
TITLE = _DECODE.format(_SQUEEZE.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
LINKS = rf"""l AS (
  SELECT page_id, href, anchor FROM (
    SELECT page_id, regexp_extract(a, '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1) AS href,
      {_SQUEEZE.format(_DECODE.format("regexp_replace(a, '(?s)<[^>]*>', '', 'g')"))} AS anchor
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\b[^>]*\bhref\s*=.*?</a>)')) AS a FROM pages)
  ) WHERE href <> '' AND anchor <> '' AND NOT starts_with(href, '#')
)"""


#: The title that counts: that of an archive's own pages is none.
_shown_title = f"CASE WHEN {TITLE} LIKE '%Wayback Machine%' THEN '' ELSE {TITLE} END"


def pages(spark, d):
    return table(spark, d, "pages")


@query("html_title", f"SELECT page_id, CASE WHEN {TITLE} LIKE '%Wayback Machine%' THEN '' ELSE {TITLE} END AS title FROM pages")
def html_title(spark, d):
    return pages(spark, d).select("page_id", H.title("html").alias("title"))


@query(
    "html_headings",
    rf"""WITH h AS (SELECT page_id, {TITLE} AS title, list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: {_SQUEEZE.format(_DECODE.format("regexp_replace(x, '(?s)<[^>]*>', '', 'g')"))}) AS hs FROM pages)
SELECT page_id, len(hs) AS n, coalesce(list_filter(hs, lambda x: x <> '' AND contains(lower(title), lower(x)))[1], hs[1], title) AS title FROM h""",
)
def html_headings(spark, d):
    return pages(spark, d).select("page_id", F.size(H.headings("html")).cast("bigint").alias("n"), H.heading_title("html").alias("title"))


@query("html_text", f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {TEXT} AS t FROM pages)")
def html_text(spark, d):
    return pages(spark, d).select("page_id", H.text("html").alias("t")).select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


_BODY = _SQUEEZE.format(_DECODE.format(rf"""regexp_replace(regexp_replace({_NOSCRIPT}, '(?is)<(nav|head|header|footer|aside|form)\b[^>]*>.*?</(nav|head|header|footer|aside|form)>|<div[^>]*class=["'']?ad["'']?[^>]*>.*?</div>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"""))


@query("html_body", f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {_BODY} AS t FROM pages)")
def html_body(spark, d):
    return pages(spark, d).select("page_id", H.body("html").alias("t")).select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("html_links", f"WITH {LINKS} SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_targets FROM l GROUP BY 1")
def html_links(spark, d):
    own = pages(spark, d).select("page_id", F.explode(H.links("html")).alias("l"))
    return own.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("l.href").alias("n_targets"))


@query("html_anchor_pairs", f"WITH {LINKS} SELECT anchor, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1")
def html_anchor_pairs(spark, d):
    own = pages(spark, d).select("page_id", F.explode(H.links("html")).alias("l"))
    return own.groupBy(F.col("l.anchor").alias("anchor")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("html_link_density", f"""WITH {LINKS}, a AS (SELECT page_id, sum(length(anchor)) AS n FROM l GROUP BY 1), t AS (SELECT page_id, length({TEXT}) AS m FROM pages)
SELECT page_id, round(CASE WHEN m = 0 THEN 0 ELSE coalesce(n, 0) / m::DOUBLE END, 6) AS density FROM t LEFT JOIN a USING (page_id)""")
def html_link_density(spark, d):
    return pages(spark, d).select("page_id", F.round(H.link_density("html"), 6).alias("density"))


_LANG = r"""lower(substring(regexp_extract(html, '(?is)<html[^>]*\blang=["'']?([A-Za-z-]+)', 1), 1, 2))"""


@query("html_lang", f"SELECT {_LANG} AS lang, count(*) AS n FROM pages GROUP BY 1")
def html_lang(spark, d):
    return pages(spark, d).groupBy(H.lang("html").alias("lang")).agg(F.count("*").alias("n"))


@query("prep_group", f"WITH {URLS} SELECT host || '|' || lower(dir) AS netloc_dir, count(DISTINCT url) AS n_urls FROM (SELECT *, regexp_replace(host, '^[^.]*www[^.]*\\.', '') AS h2 FROM s) GROUP BY h2, host || '|' || lower(dir)".replace("host || '|' || lower(dir)", "h2 || '|' || lower(dir)"))
def prep_group(spark, d):
    return prep.grouped(pages(spark, d).select("url")).groupBy("netloc_dir").agg(F.count("*").alias("n_urls"))


@query("prep_sites", f"""WITH {URLS}, l AS (SELECT host AS site, {_LANG} AS language, count(*) AS n FROM s GROUP BY 1, 2)
SELECT site, arg_min(language, (-n, language)) AS language, sum(n)::BIGINT AS pages FROM l GROUP BY 1""")
def prep_sites(spark, d):
    return prep.site_info(pages(spark, d))


_SITES = f"""l AS (SELECT host AS site, {_LANG} AS language, count(*) AS n FROM s GROUP BY 1, 2), i AS (SELECT site, arg_min(language, (-n, language)) AS language FROM l GROUP BY 1)"""


@query("prep_language", f"WITH {URLS}, {_SITES} SELECT page_id, language FROM s JOIN i ON s.host = i.site WHERE language IN ('en', 'de', 'fr')")
def prep_language(spark, d):
    p = pages(spark, d)
    return prep.in_languages(p.select("page_id", "url"), prep.site_info(p)).select("page_id", "language")


@query(
    "prep_pipeline",
    rf"""WITH {URLS}, {_SITES}, c AS (
  SELECT scheme || '://' || host || path || CASE WHEN len(list_filter(pairs, lambda x: NOT starts_with(lower(x), 'utm'))) > 0 THEN '?' || array_to_string(list_filter(pairs, lambda x: NOT starts_with(lower(x), 'utm')), '&') ELSE '' END AS url,
    regexp_replace(host, '^[^.]*www[^.]*\.', '') || '|' || lower(dir) AS netloc_dir, host
  FROM s WHERE NOT regexp_matches(lower(url), 'signin|login') AND regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> 'example.org')
SELECT DISTINCT netloc_dir, url FROM c JOIN i ON c.host = i.site WHERE language IN ('en', 'de', 'fr')""",
)
def prep_pipeline(spark, d):
    p = pages(spark, d)
    return prep.preprocess(p.select("url"), p, literal(spark, [("example.org",)], "site string"))


@query("link_edges", f"""WITH {LINKS}, {URLS}, e AS (SELECT DISTINCT s.page_id, s.host, CASE WHEN starts_with(href, '/') THEN lower(href) ELSE lower(regexp_extract(href, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) END AS target FROM l JOIN s USING (page_id))
SELECT target, count(*) AS n, count(DISTINCT host) AS hosts FROM e GROUP BY 1""")
def link_edges(spark, d):
    own = pages(spark, d).select("page_id", "url", F.explode(H.links("html")).alias("l"))
    own = own.select("page_id", U.host("url").alias("host"), F.lower(U.path(U.resolve("url", "l.href"))).alias("target")).distinct()
    return own.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))
