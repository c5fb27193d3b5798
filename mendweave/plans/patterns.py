"""Pattern mining and the verification of candidates."""

from __future__ import annotations

from mendweave.operators import patterns as P
from mendweave.operators import verify as V

from .common import URLS, F, query, table, written
from .html import _shown_title
from .neighbors import AROUND, nearest, pages
from .redirects import LOOKS, looks, redirecting

_CLS = "CASE WHEN regexp_matches({0}, '[A-Za-z]') THEN 'A' ELSE '' END || CASE WHEN regexp_matches({0}, '[0-9]') THEN 'N' ELSE '' END"
_PATS = rf"""{URLS}, q AS (SELECT page_id, url, host, bare, unnest(list_concat(segs, pairs)) AS x, unnest(range(0, len(segs) + len(pairs))) AS j, list_concat(segs, pairs) AS parts FROM s),
wq AS (SELECT *, CASE WHEN regexp_matches(x, '^[^=]+=') THEN regexp_extract(x, '^([^=]+=)', 1) || '*' || {_CLS.format("regexp_replace(x, '^[^=]+=', '')")} ELSE '*' || {_CLS.format('x')} END AS wild FROM q),
pat AS (SELECT DISTINCT page_id, bare || '|' || array_to_string(list_concat(list_concat(parts[1:j], [wild]), parts[j + 2:]), '|') AS pattern FROM wq)"""


@query("pattern_gen", f"WITH {_PATS} SELECT page_id, pattern FROM pat")
def pattern_gen(spark, d):
    return P.index(pages(spark, d), "page_id")


@query("pattern_gen_two", f"""WITH {_PATS}, two AS (SELECT DISTINCT a.page_id, a.bare || '|' || array_to_string(CASE WHEN a.j = b.j THEN list_concat(list_concat(a.parts[1:a.j], [a.wild]), a.parts[a.j + 2:])
  ELSE list_concat(list_concat(list_concat(list_concat(a.parts[1:a.j], [a.wild]), a.parts[a.j + 2:b.j]), [b.wild]), a.parts[b.j + 2:]) END, '|') AS pattern FROM wq a JOIN wq b ON a.page_id = b.page_id AND a.j <= b.j)
SELECT page_id, count(*) AS n, min(pattern) AS first FROM two GROUP BY 1""")
def pattern_gen_two(spark, d):
    return P.index(pages(spark, d), "page_id", max_diff=2).groupBy("page_id").agg(F.count("*").alias("n"), F.min("pattern").alias("first"))


@query("pattern_groups", f"WITH {_PATS}, g AS (SELECT pattern, count(*) AS n, min(page_id) AS first, max(page_id) AS last, list_sort(list(page_id)) AS ids FROM pat GROUP BY 1 HAVING count(*) >= 2) SELECT min(pattern) AS pattern, n, first, last FROM g GROUP BY n, first, last, ids")
def pattern_groups(spark, d):
    return P.groups(P.index(pages(spark, d), "page_id"), "page_id")


@query("pattern_match", f"WITH {_PATS} SELECT a.page_id AS query, a.pattern, count(DISTINCT b.page_id) AS n FROM pat a JOIN pat b ON a.pattern = b.pattern AND a.page_id <> b.page_id WHERE a.page_id % 50 = 0 GROUP BY 1, 2 HAVING count(DISTINCT b.page_id) >= 2")
def pattern_match(spark, d):
    """Patterns of the queries (ids divisible by 50) that at least two other pages share."""
    own = P.index(pages(spark, d), "page_id")
    return P.match(own, own.where("page_id % 50 = 0"), "page_id")


_PATEXT = "pe AS (SELECT pat.*, s.ext FROM pat JOIN s USING (page_id)), mx AS (SELECT a.page_id AS query, a.pattern, count(DISTINCT b.page_id) AS n FROM pe a JOIN pe b ON a.pattern = b.pattern AND a.ext = b.ext AND a.page_id <> b.page_id WHERE a.page_id % 50 = 0 GROUP BY 1, 2 HAVING count(DISTINCT b.page_id) >= 2)"


def _with_ext(spark, d):
    from mendweave.functions import urls as U

    own = P.index(pages(spark, d), "page_id").join(pages(spark, d).select("page_id", U.extension(U.path("url")).alias("ext")), "page_id")
    return own, P.match(own, own.where("page_id % 50 = 0"), "page_id", ext="ext")


@query("pattern_match_ext", f"WITH {_PATS}, {_PATEXT} SELECT query, pattern, n FROM mx")
def pattern_match_ext(spark, d):
    """The same among pages with the query's extension."""
    return _with_ext(spark, d)[1]


@query("pattern_popped", f"WITH {_PATS}, {_PATEXT} SELECT count(*) AS n, count(DISTINCT pattern) AS patterns FROM pat WHERE pattern NOT IN (SELECT pattern FROM mx)")
def pattern_popped(spark, d):
    """What is left of the index once the matched patterns are taken out."""
    return P.popped(*_with_ext(spark, d)).agg(F.count("*").alias("n"), F.countDistinct("pattern").alias("patterns"))


@query("query_value_counts", rf"WITH {URLS}, v AS (SELECT regexp_replace(host, '^[^.]*www[^.]*\.', '') || '|' || lower(dir) AS section, unnest(list_transform(pairs, lambda x: regexp_extract(x, '^[^=]+=(.*)$', 1))) AS value FROM s) SELECT section, value, count(*) AS n FROM v GROUP BY 1, 2")
def query_value_counts(spark, d):
    return P.value_counts(pages(spark, d))


@query(
    "unique_tokens",
    rf"""WITH {URLS}, k AS (SELECT page_id, host, unnest(list_distinct(list_transform(segs, lambda x: lower(x)))) AS token FROM s), once AS (SELECT host, token FROM k GROUP BY 1, 2 HAVING count(*) = 1)
SELECT page_id, string_agg(token, ' ' ORDER BY -length(token), token) AS tokens FROM k JOIN once USING (host, token)
WHERE (CASE WHEN regexp_matches(token, '^[0-9]{{1,18}}$') THEN CAST(token AS BIGINT) > 2050 ELSE len(string_split_regex(token, '[^\p{{L}}\p{{N}}]+')) > 1 END) OR length(token) > 5 GROUP BY 1""".replace("CAST(token AS BIGINT)", "TRY_CAST(token AS BIGINT)"),
)
def unique_tokens(spark, d):
    return P.unique_tokens(pages(spark, d), "page_id")


# --- verification: candidates are the neighbours of each page, found in a way that depends on its id ---------------

_METHOD = "CASE page_id % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'token' WHEN 2 THEN 'wayback_alias' ELSE 'content' END"
_NORM = """regexp_replace({a}bare || CASE WHEN lower({a}path) IN ('', '/') THEN '/' ELSE regexp_replace(lower({a}path), '/$', '') END, '$', '') || CASE WHEN {a}query = '' THEN '' WHEN len({a}pairs) > 0 THEN '?' || array_to_string(list_sort(list_transform({a}pairs, lambda x: lower(x))), '&') ELSE '?' || lower({a}query) END"""
CANDS = f"""{AROUND}, cd AS (SELECT r.page_id, r.cand_id, CASE WHEN {_METHOD.replace('page_id', 'r.page_id')} = 'token' AND r.cand_id % 2 = 0 THEN 'fuzzy' ELSE {_METHOD.replace('page_id', 'r.page_id')} END AS method,
  {_NORM.format(a='a.')} AS nurl, {_NORM.format(a='b.')} AS ncand, b.bare AS host
  FROM ranked r JOIN s a ON a.page_id = r.page_id JOIN s b ON b.page_id = r.cand_id WHERE rank <= 3)"""


def candidates(spark, d):

    best = nearest(spark, d, 3)
    return best.select("page_id", "url", "cand_id", F.col("cand_url").alias("cand"), F.expr(_METHOD).alias("method"), F.when(F.col("cand_id") % 2 == 0, 0.9).otherwise(1.0).alias("value"))


def ingested(spark, d):
    return V.ingest(candidates(spark, d))


@query("verify_ingest", f"WITH {CANDS} SELECT page_id, cand_id, method, nurl, ncand FROM cd")
def verify_ingest(spark, d):
    return ingested(spark, d).select("page_id", "cand_id", "method", "nurl", "ncand")


_KEPT = "mc AS (SELECT ncand FROM cd WHERE method <> 'fuzzy' GROUP BY 1 HAVING count(DISTINCT nurl) > 2), kept AS (SELECT * FROM cd WHERE ncand NOT IN (SELECT ncand FROM mc))"
_MULTI = f"{CANDS}, {_KEPT}"


@query("verify_multicast", f"WITH {_MULTI} SELECT page_id, cand_id FROM kept")
def verify_multicast(spark, d):
    return V.drop_multicast(ingested(spark, d)).select("page_id", "cand_id")


_SPLIT = r"list_filter(string_split_regex(regexp_replace({0}, '\.[a-z0-9]+$', ''), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BIGRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_NUMBER = "regexp_extract({0}, '^0*([0-9]+)$', 1)"
#: A grade for each token of the candidate: the best by the URL's tokens, or a shared prefix.
_GRADED = f"""kt AS (SELECT k.*, a.tok AS t1, b.tok AS t2 FROM kept k JOIN o a ON a.page_id = k.page_id JOIN o b ON b.page_id = k.cand_id),
ea AS (SELECT DISTINCT nurl, ncand, t2[1] AS site, unnest(range(0, len(t2))) AS i, unnest(t2) AS token FROM kt),
mn AS (SELECT site, i, token FROM ea GROUP BY site, i, token HAVING count(DISTINCT nurl) > 1 AND count(DISTINCT ncand) > 1),
sh AS (SELECT DISTINCT nurl, ncand, i FROM ea JOIN mn USING (site, i, token)),
gt AS (SELECT *, len(t2) AS size, unnest(range(0, len(t2))) AS i, unnest(t2) AS token FROM kt),
gw AS (SELECT *, {_SPLIT.format('source')} AS a, {_SPLIT.format('token')} AS b FROM (SELECT *, unnest(t1) AS source FROM gt)),
gc AS (SELECT *, len(list_intersect(list_distinct(a), list_distinct(b))) AS common,
  CASE WHEN len(a) < 2 OR len(b) < 2 THEN 0 ELSE len(list_intersect({_BIGRAMS.format('a')}, {_BIGRAMS.format('b')})) / (len(b) - 1)::DOUBLE END AS shared FROM gw),
gg AS (SELECT page_id, cand_id, nurl, ncand, method, host, size, i, max(CASE
  WHEN token = source OR (regexp_matches(token, '^[0-9]+$') AND regexp_matches(source, '^[0-9]+$') AND {_NUMBER.format('token')} = {_NUMBER.format('source')}) THEN 3
  WHEN len(a) = 0 OR len(b) = 0 OR (len(a) = 1) <> (len(b) = 1) THEN 0
  WHEN common = len(list_distinct(b)) AND common >= 0.5 * len(list_distinct(a)) THEN 3 WHEN shared >= 0.5 THEN 1 ELSE 0 END) AS g FROM gc GROUP BY ALL),
gr AS (SELECT gg.*, CASE WHEN sh.i IS NOT NULL AND gg.i < size - 1 THEN greatest(g, 2) ELSE g END AS grade FROM gg LEFT JOIN sh ON sh.nurl = gg.nurl AND sh.ncand = gg.ncand AND sh.i = gg.i),
ru AS (SELECT page_id, cand_id, nurl, ncand, method, host, size, string_agg(grade, ',' ORDER BY i) AS rule, round(-sum(CASE WHEN grade = 0 THEN (i + 1) / size::DOUBLE ELSE 0 END), 9) AS pred FROM gr GROUP BY ALL)"""
_RULES = f"{_MULTI}, {_GRADED}"
_WORTH = "CASE method WHEN 'wayback_alias' THEN 2.0 WHEN 'title' THEN 1.0 WHEN 'content' THEN 1.0 WHEN 'token' THEN 0.5 ELSE 0.0 END::DOUBLE"
_SCORED = f"""cl AS (SELECT host, rule, size, count(DISTINCT nurl) AS n_urls, count(DISTINCT ncand) AS n_cands, min(pred) AS pred FROM ru GROUP BY 1, 2, 3),
hi AS (SELECT host, rule, sum({_WORTH}) AS hint FROM (SELECT DISTINCT host, rule, method FROM ru) GROUP BY 1, 2), cs AS (SELECT * FROM cl JOIN hi USING (host, rule))"""
_CLUSTERS = f"{_RULES}, {_SCORED}"
_FIRST = """tr AS (SELECT *, row_number() OVER w AS rank, first(size) OVER w AS n, first(pred) OVER w AS p FROM cs WINDOW w AS (PARTITION BY host ORDER BY hint DESC, pred DESC, n_urls DESC, rule)),
tp AS (SELECT * FROM tr x WHERE NOT EXISTS (SELECT 1 FROM tr y WHERE y.host = x.host AND y.rank <= x.rank AND (y.size <> y.n OR y.pred < y.p)))"""
_TOP = f"{_CLUSTERS}, {_FIRST}"
_CHOSEN = f"""cr AS (SELECT host, rule, nurl, ncand, sum({_WORTH}) AS credit FROM ru JOIN tp USING (host, rule) GROUP BY 1, 2, 3, 4), fa AS (SELECT *, count(*) OVER (PARTITION BY host, rule, nurl) AS fan FROM cr)"""
_EMIT = f"{_TOP}, {_CHOSEN}"
#: From candidates, a table cd, to the choice.
VERIFIED = ", ".join((_KEPT, _GRADED, _SCORED, _FIRST, _CHOSEN))


def ruled(spark, d):
    return written(V.rules(V.drop_multicast(written(ingested(spark, d)))))  # clusters read it several times


@query("verify_rules", f"WITH {_RULES} SELECT page_id, cand_id, rule FROM ru")
def verify_rules(spark, d):
    return ruled(spark, d).select("page_id", "cand_id", F.concat_ws(",", F.transform("rule", lambda g: g.cast("string"))).alias("rule"))


@query("verify_clusters", f"WITH {_CLUSTERS} SELECT host, rule, n_urls, n_cands, hint, round(pred, 6) AS pred FROM cs")
def verify_clusters(spark, d):
    return V.clusters(ruled(spark, d)).select("host", "rule", "n_urls", "n_cands", "hint", F.round("pred", 6).alias("pred"))


@query("verify_top", f"WITH {_TOP} SELECT host, rule, rank FROM tp")
def verify_top(spark, d):
    return V.top(V.clusters(ruled(spark, d))).select("host", "rule", F.col("rank").cast("bigint").alias("rank"))


@query("verify_emit", f"WITH {_EMIT} SELECT nurl, ncand, credit, row_number() OVER (PARTITION BY nurl ORDER BY credit DESC, ncand) AS rank FROM fa WHERE fan < 4 AND credit > 0")
def verify_emit(spark, d):
    own = ruled(spark, d)
    return V.choose(own, V.top(V.clusters(own)))


@query("verify_hints", f"WITH {_MULTI}, m AS (SELECT DISTINCT host, method FROM kept) SELECT host, sum(CASE method WHEN 'wayback_alias' THEN 2.0 WHEN 'title' THEN 1.0 WHEN 'content' THEN 1.0 WHEN 'token' THEN 0.5 ELSE 0.0 END)::DOUBLE AS hint FROM m GROUP BY 1")
def verify_hints(spark, d):
    from mendweave.functions import urls as U

    worth = F.create_map(*[F.lit(x) for kv in V.HINTS.items() for x in kv])
    own = V.drop_multicast(ingested(spark, d)).select(U.bare_host("cand").alias("host"), "method").distinct()
    return own.groupBy("host").agg(F.sum(F.coalesce(F.try_element_at(worth, F.col("method")), F.lit(0.0))).alias("hint"))


_TWICE = """two AS (SELECT DISTINCT a.page_id, a.bare || '|' || array_to_string(CASE WHEN a.j = b.j THEN list_concat(list_concat(a.parts[1:a.j], [a.wild]), a.parts[a.j + 2:])
  ELSE list_concat(list_concat(list_concat(list_concat(a.parts[1:a.j], [a.wild]), a.parts[a.j + 2:b.j]), [b.wild]), a.parts[b.j + 2:]) END, '|') AS pattern FROM wq a JOIN wq b ON a.page_id = b.page_id AND a.j <= b.j)"""


_UPWARD = r"list_transform(range(0, len(ds) + 1), lambda k: regexp_replace(host, '^[^.]*www[^.]*\.', '') || '|' || array_to_string(ds[1:len(ds) - k], '/'))"


@query(
    "pattern_redirected",
    rf"""WITH {LOOKS}, {_PATS.removeprefix(URLS + ', ')}, {_TWICE},
dd AS (SELECT page_id, url, mk, ext, {_UPWARD} AS dirs FROM (SELECT *, list_filter(string_split(lower(dir), '/'), lambda x: x <> '') AS ds FROM o)),
re AS (SELECT mk, min(page_id) AS page_id FROM dd JOIN la USING (url) GROUP BY 1), rd AS (SELECT dd.* FROM re JOIN dd USING (page_id)),
pb AS (SELECT t.page_id, min(lv) AS level FROM (SELECT page_id, mk, dirs, unnest(range(0, least(2, len(dirs)))) AS lv FROM dd WHERE page_id % 50 = 0) t JOIN rd ON list_contains(rd.dirs, t.dirs[lv + 1]) AND rd.mk <> t.mk GROUP BY 1)
SELECT t.page_id, level, a.pattern, count(DISTINCT rd.mk) AS n FROM pb JOIN dd t USING (page_id) JOIN two a ON a.page_id = t.page_id JOIN two b ON b.pattern = a.pattern JOIN rd ON rd.page_id = b.page_id
WHERE rd.ext = t.ext AND rd.mk <> t.mk AND list_contains(rd.dirs, t.dirs[level + 1]) GROUP BY 1, 2, 3 HAVING count(DISTINCT rd.mk) >= 2""",
)
def pattern_redirected(spark, d):
    """Patterns that a target (ids divisible by 50) shares with redirecting URLs of its directory, or of the one above."""
    moved = written(redirecting(looks(spark, d)))
    return P.redirected(pages(spark, d).where("page_id % 50 = 0"), moved, "page_id").withColumn("level", F.col("level").cast("bigint"))


@query("verify_rematch", f"WITH {_RULES}, rt AS (SELECT page_id, cand_id, host, rule, nurl, ncand, method, count(DISTINCT ncand) OVER (PARTITION BY host, rule, nurl) AS fan, ct.c IS NOT NULL AS ok FROM ru LEFT JOIN (SELECT a.page_id AS x, b.page_id AS y, 1 AS c FROM titled a JOIN titled b ON a.title = b.title AND a.host = b.host AND a.page_id <> b.page_id WHERE a.title <> '') ct ON x = page_id AND y = cand_id), go AS (SELECT *, bool_or(ok) OVER (PARTITION BY host, rule, nurl) AS good FROM rt) SELECT page_id, cand_id, CASE WHEN fan > 1 AND ok THEN 'title' ELSE method END AS method FROM go WHERE fan <= 1 OR NOT good OR ok".replace("SELECT page_id, cand_id, CASE WHEN", "SELECT page_id, cand_id, CASE WHEN", 1).replace(f"WITH {_RULES}", f"WITH {_RULES}, titled AS (SELECT page_id, host, {_shown_title} AS title FROM s)", 1))
def verify_rematch(spark, d):
    """Candidates after a second look where a cluster has several for a URL: those with the same title stay, if there are any."""
    from mendweave.functions import html as H
    from mendweave.functions import urls as U

    own = ruled(spark, d)
    asked = V.crowded(own, 1).join(own.select("nurl", "ncand", "url", "cand").distinct(), ["nurl", "ncand"])
    titles = table(spark, d, "pages").select("url", U.host("url").alias("host"), H.title("html").alias("title")).where("title <> ''")
    other = titles.select(F.col("url").alias("cand"), "host", "title")
    same = asked.join(titles, "url").join(other, ["cand", "host", "title"]).select("nurl", "ncand", F.lit("title").alias("type"))
    return V.rematch(own, same, 1).select("page_id", "cand_id", "method")
