"""Links of a page and of the next page on its host, taken as two versions, matched by their texts."""

from __future__ import annotations

from mendweave.operators import links as L

from .common import PAIRS, URLS, F, query, table, written
from .html import _DECODE, _SQUEEZE, LINKS
from .urls import next_on_host

_ITEM = _SQUEEZE.format(_DECODE.format("regexp_extract({0}, '>([^<>]*)</a>', 1)"))
#: Links in list items, with the texts of the items beside them; on these pages all links stand so.
SIGS = rf"""nv AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS li FROM pages),
ix AS (SELECT page_id, url, li, unnest(range(1, len(li) + 1)) AS i FROM nv),
lk AS (SELECT DISTINCT page_id, regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) || regexp_extract(li[i], 'href="([^"]*)"', 1) AS link, {_ITEM.format('li[i]')} AS anchor,
  CASE WHEN i > 1 THEN {_ITEM.format('li[i - 1]')} END AS before, CASE WHEN i < len(li) THEN {_ITEM.format('li[i + 1]')} END AS after FROM ix)"""
_TERMS = r"regexp_extract_all(lower(replace({0}, '_', ' ')), '[\p{{L}}\p{{N}}_]+')"
MATCHED = f"""WITH {PAIRS}, pr AS (SELECT page_id, id2 FROM k), {SIGS},
tx AS (SELECT page_id, 'anchor' AS kind, anchor AS text FROM lk UNION SELECT page_id, 'sig', before FROM lk WHERE before IS NOT NULL UNION SELECT page_id, 'sig', after FROM lk WHERE after IS NOT NULL),
dt AS (SELECT DISTINCT text FROM tx), tt AS (SELECT text, unnest({_TERMS.format('text')}) AS term FROM dt), tf AS (SELECT text, term, count(*) AS tf FROM tt GROUP BY 1, 2),
df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM dt)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT text, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY text)) AS w FROM tf JOIN df USING (term)),
cs AS (SELECT pr.page_id, pr.id2, a.kind, a.text AS told, b.text AS tnew, sum(x.w * y.w) AS c FROM pr JOIN tx a ON a.page_id = pr.page_id JOIN w x ON x.text = a.text JOIN tx b ON b.page_id = pr.id2 AND b.kind = a.kind JOIN w y ON y.text = b.text AND y.term = x.term GROUP BY ALL),
oc AS (SELECT *, list_filter([before, after], lambda z: z IS NOT NULL) AS sig FROM lk),
ma AS (SELECT cs.page_id, id2, a.link, a.anchor, a.sig, b.link AS found, c AS by_anchor, 0.0 AS by_sig FROM cs JOIN oc a ON a.page_id = cs.page_id AND a.anchor = told JOIN oc b ON b.page_id = id2 AND b.anchor = tnew WHERE kind = 'anchor'
  UNION ALL SELECT cs.page_id, id2, a.link, a.anchor, a.sig, b.link, 0.0, c FROM cs JOIN oc a ON a.page_id = cs.page_id AND list_contains(a.sig, told) JOIN oc b ON b.page_id = id2 AND list_contains(b.sig, tnew) WHERE kind = 'sig'),
mt AS (SELECT page_id, id2, link, anchor, sig, found, max(by_anchor) AS by_anchor, max(by_sig) AS by_sig FROM ma GROUP BY ALL)"""


def matched(spark, d):
    own = written(L.signatures(table(spark, d, "pages"), "page_id"))
    return L.matched(next_on_host(spark, d).select("page_id", "id2"), own, "page_id", "id2", "page_id")


@query("html_link_signatures", f"WITH {SIGS} SELECT page_id, link, anchor, coalesce(before, '-') AS before, coalesce(after, '-') AS after FROM lk")
def html_link_signatures(spark, d):
    """Links with their texts and what stands beside them, from each page's tree."""
    from mendweave.functions import trees as T
    from mendweave.functions import urls as U

    own = table(spark, d, "pages").select("page_id", "url", F.explode(T.link_signatures("html")).alias("l"))
    return own.select("page_id", U.resolve("url", "l.href").alias("link"), "l.anchor", F.coalesce("l.before", F.lit("-")).alias("before"), F.coalesce("l.after", F.lit("-")).alias("after"))


@query("link_sig_matches", f"{MATCHED} SELECT page_id, id2, link, found, round(max(by_anchor), 6) AS by_anchor, round(max(by_sig), 6) AS by_sig, count(*) AS places FROM mt GROUP BY 1, 2, 3, 4")
def link_sig_matches(spark, d):
    """For each link of a page and each target of the other version's links, how much anchors and texts beside them are alike."""
    own = matched(spark, d).groupBy("page_id", "id2", "link", "found")
    return own.agg(F.round(F.max("by_anchor"), 6).alias("by_anchor"), F.round(F.max("by_sig"), 6).alias("by_sig"), F.count("*").alias("places"))


@query("link_same", f"""{MATCHED}, gd AS (SELECT * FROM mt WHERE round(by_anchor, 9) >= 0.8), gn AS (SELECT page_id, id2, link, anchor, sig, count(*) AS n FROM gd GROUP BY ALL),
g2 AS (SELECT gd.*, n, row_number() OVER (PARTITION BY gd.page_id, gd.id2, gd.link, gd.anchor, gd.sig ORDER BY round(by_sig, 9) DESC, found) AS r FROM gd JOIN gn ON gd.page_id = gn.page_id AND gd.id2 = gn.id2 AND gd.link = gn.link AND gd.anchor = gn.anchor AND gd.sig = gn.sig),
fo AS (SELECT page_id, id2, link, found, 'anchor' AS way, round(by_anchor, 9) AS score FROM g2 WHERE n = 1
  UNION ALL SELECT page_id, id2, link, max(CASE WHEN r = 1 THEN found END), 'sig', max(CASE WHEN r = 1 THEN round(by_sig, 9) END) AS s FROM g2 WHERE n > 1 AND r <= 2 GROUP BY page_id, id2, link, anchor, sig HAVING max(CASE WHEN r = 1 THEN round(by_sig, 9) END) >= 0.8 AND max(CASE WHEN r = 2 THEN round(by_sig, 9) END) < 0.8)
SELECT page_id, id2, link, arg_min(found, (-score, way, found)) AS found, arg_min(way, (-score, way, found)) AS way, round(max(score), 6) AS score FROM fo GROUP BY 1, 2, 3""")
def link_same(spark, d):
    """Where the other version has each link: by the one anchor that is alike, else by the texts beside those that are."""
    return L.same_link(matched(spark, d), "page_id", "id2").withColumn("score", F.round("score", 6))


@query("link_likely", f"""{MATCHED}, sc AS (SELECT page_id, id2, link, found, max(round(0.75 * by_anchor + 0.25 * by_sig, 9)) AS score FROM mt GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY page_id, id2, link ORDER BY score DESC, found) AS rank FROM sc) SELECT page_id, id2, link, found, round(score, 6) AS score, rank FROM rk WHERE rank <= 10""")
def link_likely(spark, d):
    """The links of the other version that are looked at for each link, three quarters by the anchor and a quarter by what is beside it."""
    return L.likely_links(matched(spark, d), "page_id", "id2").withColumn("score", F.round("score", 6))


def ways(spark, d):
    """Links between URLs of a host and back along them, with their texts."""
    from mendweave.functions import html as H
    from mendweave.functions import urls as U

    own = table(spark, d, "pages").select("url", F.explode(H.links("html")).alias("l"))
    to = F.concat(F.lit("http://"), U.host("url"), U.path(U.resolve("url", "l.href")))
    forth = own.select(F.col("url").alias("src"), to.alias("dst"), F.col("l.anchor").alias("text"))
    return written(forth.unionByName(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "text")).distinct())


def likeness(spark, d, edges):
    """(target, text, score): how much a link's text is like the title of a target (ids divisible by 50)."""
    from mendweave.functions import html as H

    titles = table(spark, d, "pages").where("page_id % 50 = 0").select(F.col("url").alias("target"), H.title("html").alias("title"))
    w = written(L.text_weights(edges.select("text").union(titles.select(F.col("title").alias("text"))).distinct()))
    a = titles.join(w.select(F.col("text").alias("title"), "term", F.col("w").alias("a")), "title").select("target", "term", "a")
    return a.join(w.select("text", "term", F.col("w").alias("b")), "term").groupBy("target", "text").agg((L.ANCHOR * F.sum(F.col("a") * F.col("b"))).alias("score"))


_WAYS = rf"""{LINKS}, {URLS}, fw AS (SELECT DISTINCT url AS src, 'http://' || host || CASE WHEN starts_with(href, '/') THEN regexp_extract(href, '^[^?#]*', 0) ELSE regexp_extract(href, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END AS dst FROM l JOIN s USING (page_id)),
bw AS (SELECT src, dst FROM fw UNION SELECT dst, src FROM fw), st AS (SELECT a.url AS target, arg_min(b.url, b.page_id) AS start FROM s a JOIN s b ON a.host = b.host WHERE a.page_id % 50 = 0 GROUP BY 1)"""


@query("link_paths", f"WITH RECURSIVE {_WAYS}, r AS (SELECT target, start AS node, 0 AS depth FROM st UNION SELECT r.target, bw.dst, r.depth + 1 FROM r JOIN bw ON bw.src = r.node WHERE r.depth < 4) SELECT target, min(depth)::BIGINT AS length FROM r WHERE node = target GROUP BY 1")
def link_paths(spark, d):
    """How many links lead from the first page of its host to each target (ids divisible by 50), along links and back."""
    from mendweave.functions import urls as U
    from mendweave.operators import graph as G

    edges = ways(spark, d)
    pages = table(spark, d, "pages").select("page_id", "url", U.host("url").alias("host"))
    first = pages.groupBy("host").agg(F.min_by("url", "page_id").alias("start"))
    targets = pages.where("page_id % 50 = 0").select(F.col("url").alias("node"), "host").distinct()
    # a host's targets have one start, so what it reaches is found once, and wholly
    found = G.reach(written(edges.select("src", "dst").distinct()), written(first.select(F.col("start").alias("node")).distinct()), 4)
    met = targets.join(first, "host").join(found, ["start", "node"])
    return met.groupBy(F.col("node").alias("target")).agg(F.min("depth").cast("bigint").alias("length"))
