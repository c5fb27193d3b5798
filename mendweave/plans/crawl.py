"""How pages are fetched, over looks at pages and what they hold, and the smaller values on the way."""

from __future__ import annotations

from mendweave.functions import diffs as D
from mendweave.functions import text as X
from mendweave.functions import urls as U
from mendweave.operators import crawl as C
from mendweave.operators import ordered as O
from mendweave.operators import programs as P
from mendweave.operators import verify as V

from .common import PAIRS, URLS, F, query, table
from .evidence import _FINAL, finals
from .graphs import _MOVED, moved
from .patterns import _RULES, ruled
from .redirects import LOOKS, looks
from .urls import next_on_host


@query("crawl_readable", f"WITH {LOOKS} SELECT event_id, status NOT LIKE '4%' AND url NOT LIKE '%utm%' AND regexp_extract(lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)), '(\\.[a-z0-9]+)$', 1) <> '.pdf' AS ok FROM vi")
def crawl_readable(spark, d):
    """Looks whose answer is kept; feeds' links are answered as XML here."""
    kind = F.when(F.col("url").contains("utm"), "application/xml").otherwise("text/HTML; charset=utf-8")
    return looks(spark, d).withColumn("type", kind).select("event_id", C.readable("url", "status", "type").alias("ok"))


@query("crawl_proxies", "WITH r AS (SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS k FROM pages) SELECT page_id, ['http://p0:80', 'http://p1:80', 'http://p2:80'][k % 3 + 1] AS proxy FROM r")
def crawl_proxies(spark, d):
    """Proxies in turn, in the order of the URLs."""
    return C.assigned(table(spark, d, "pages").select("page_id", "url"), [f"http://p{k}:80" for k in range(3)], ["url", "page_id"]).select("page_id", "proxy")


_MAPS = r"regexp_extract_all(string_agg(CASE WHEN query LIKE 'utm%' THEN 'Sitemap: ' || url ELSE 'Allow: ' || path END, chr(10) ORDER BY page_id), '(?m)^Sitemap: (\S+)', 1)"


@query("crawl_sitemaps", f"WITH {URLS}, r AS (SELECT host, {_MAPS} AS maps, min(length(path)) AS least FROM s GROUP BY 1) SELECT DISTINCT host, unnest(CASE WHEN len(maps) > 0 THEN maps WHEN least <= 7 THEN ['http://' || host || '/sitemap.xml'] ELSE [] END) AS sitemap FROM r")
def crawl_sitemaps(spark, d):
    """Sitemaps that robots files name, here the pages that feeds link to, else the usual ones, which hosts with a short path have."""
    own = table(spark, d, "pages").select("page_id", "url", U.host("url").alias("host"))
    line = F.when(U.query("url").startswith("utm"), F.concat(F.lit("Sitemap: "), "url")).otherwise(F.concat(F.lit("Allow: "), U.path("url")))
    lines = F.array_sort(F.collect_list(F.struct("page_id", line.alias("line"))))
    robots = own.groupBy("host").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), F.min(F.length(U.path("url"))).alias("least"))
    answers = robots.select(F.concat(F.lit("http://"), "host", F.lit("/sitemap.xml")).alias("url"), F.when(F.col("least") <= 7, 200).otherwise(404).alias("status"))
    return C.sitemaps(own, robots, answers)


@query(
    "crawl_technologies",
    f"""WITH {URLS}, t AS (SELECT page_id, 'Programming Languages' AS category, 'PHP' AS name FROM s WHERE query <> '' UNION ALL SELECT page_id, 'CMS', 'Blog' FROM s WHERE host LIKE 'blog.%'
UNION ALL SELECT page_id, 'Web servers', 'Server of ' || host FROM s) SELECT page_id, category, array_to_string(list_sort(list(name)), ', ') AS names FROM t GROUP BY 1, 2""",
)
def crawl_technologies(spark, d):
    """Technologies of pages by category, from a probe's answers made of the forms of their URLs."""
    tech = lambda name, *ids: F.struct(name.alias("name"), F.array(*(F.struct(F.lit(i).alias("id")) for i in ids)).alias("categories"))
    found = F.array_compact(F.array(F.when(U.query("url") != "", tech(F.lit("PHP"), 27, 99)), F.when(U.host("url").startswith("blog."), tech(F.lit("Blog"), 1)), tech(F.concat(F.lit("Server of "), U.host("url")), 22, 22)))
    probes = table(spark, d, "pages").select("page_id", F.to_json(F.struct(F.lit("x").alias("urls"), found.alias("technologies"))).alias("answer"))
    return C.technologies(probes, "page_id", "answer").select("page_id", "category", F.array_join("names", ", ").alias("names"))


@query("neigh_moved", f"WITH {LOOKS}, {_FINAL} SELECT a.url, coalesce(b.canonical, a.final) AS alias FROM pg a JOIN pg b ON b.url = a.final WHERE a.mk <> b.mk AND coalesce(a.status, '') NOT LIKE '4%'")
def neigh_moved(spark, d):
    """Neighbours that work and lead elsewhere: where to, by its canonical URL."""
    own = finals(spark, d)
    there = own.select(F.col("url").alias("final_url"), F.col("canonical").alias("named"))
    works = own.where(~F.coalesce("status", F.lit("")).startswith("4")).select("url", "final_url").join(there, "final_url")
    return C.moved_alias(works, canonical="named")


@query("infer_skips", f"WITH {_MOVED} SELECT cluster, count(*) AS pages, coalesce(max(n), 0) < 2 AS skip FROM mv LEFT JOIN cx USING (cluster) GROUP BY 1")
def infer_skips(spark, d):
    """Clusters of which nothing can be inferred, as no program gives their aliases' pieces."""
    own = moved(spark, d)
    model = P.chosen(*P.agreed(P.fair_examples(own.where("alias IS NOT NULL")))).select("cluster").withColumn("told", F.lit(True))
    return own.groupBy("cluster").agg(F.count("*").alias("pages")).join(model, "cluster", "left").select("cluster", "pages", F.col("told").isNull().alias("skip"))


@query("verify_skips", f"WITH {_RULES} SELECT host, count(DISTINCT rule) AS rules, bool_and(rule[-1] = '0') AS skip FROM ru GROUP BY 1")
def verify_skips(spark, d):
    """Hosts whose clusters all leave the last token of an alias untold, so that nothing can be inferred from them."""
    own = ruled(spark, d).select(U.bare_host("cand").alias("host"), "rule")
    last = F.element_at("rule", -1) < V.MIX
    return own.groupBy("host").agg(F.countDistinct("rule").alias("rules"), F.bool_and(last).alias("skip"))


_SIZE = "len(list_filter(range(1, n + 1), lambda i: segs[i] <> segs2[i])) + abs(len(segs) - len(segs2))"


@query("delta_order", f"WITH {PAIRS}, x AS (SELECT page_id, host, {_SIZE} AS size FROM k) SELECT page_id, size::BIGINT AS size, row_number() OVER (PARTITION BY host ORDER BY size, page_id) AS pos FROM x")
def delta_order(spark, d):
    """Pairs of pages of a host, those with fewest path segments that differ first."""
    x, y = U.segments(U.path("url")), U.segments(U.path("url2"))
    n = F.least(F.size(x), F.size(y))
    apart = F.size(F.filter(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p != q), lambda e: e)) + F.abs(F.size(x) - F.size(y))
    own = next_on_host(spark, d).select("page_id", U.host("url").alias("host"), apart.cast("bigint").alias("size"))
    return O.numbered(own, ["host"], ["size", "page_id"], "pos").select("page_id", "size", "pos")


@query("alias_values", f"WITH {PAIRS} SELECT page_id, id2, url || ' => ' || url2 || ' (content)' AS text FROM k")
def alias_values(spark, d):
    """A pair of a URL and its alias as a value: the pair, its text, and what must change."""
    own = next_on_host(spark, d).select("page_id", "id2", F.struct("url", F.col("url2").alias("alias"), F.lit("content").alias("method"), D.signature(D.token_diffs(U.tokens("url"), U.tokens("url2"))).alias("diffs")).alias("a"))
    return own.select("page_id", "id2", F.format_string("%s => %s (%s)", "a.url", "a.alias", "a.method").alias("text"))


@query("text_num_words", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> '')) AS n FROM documents")
def text_num_words(spark, d):
    """Words between single spaces, once white space is squeezed."""
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(X.squeeze("text"), " "), lambda w: w != "")).cast("bigint").alias("n"))
