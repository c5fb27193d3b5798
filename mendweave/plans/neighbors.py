"""Neighbours and the flagship query: the best replacement for each page on its host."""

from __future__ import annotations

from mendweave.functions import urls as U
from mendweave.operators import neighbors as B

from .common import KEY, PAIRS, URLS, F, query, table

_TOK = "list_concat([{b}], list_transform({s}, lambda x: lower(x)), list_transform({p}, lambda x: lower(regexp_extract(x, '^[^=]+=(.*)$', 1))))"
_CLASS = "CASE WHEN regexp_matches({0}, '[A-Za-z]') THEN 'A' ELSE '' END || CASE WHEN regexp_matches({0}, '[0-9]') THEN 'N' ELSE '' END"
_KEYS = "list_transform({0}, lambda x: regexp_extract(x, '^([^=]+)=', 1))"
_VALS = "list_transform({0}, lambda x: regexp_extract(x, '^[^=]+=(.*)$', 1))"
_WORDS = f"[{', '.join(repr(w) for w in U.ERROR_WORDS)}]"

#: All pages of the hosts of the targets (ids divisible by 50), with the ranking's key.
AROUND = f"""{URLS}, o AS (SELECT *, {KEY} AS mk, {_TOK.format(b='bare', s='segs', p='pairs')} AS tok FROM s),
c AS (SELECT a.page_id, b.page_id AS cand_id, a.mk AS m1, b.mk AS norm, a.ext AS e1, b.ext AS e2, a.tok AS t1, b.tok AS t2, a.pairs AS p1, b.pairs AS p2, a.path AS path1, a.query AS q1, b.path AS path2, b.query AS q2, b.leaf AS leaf2
  FROM o a JOIN o b ON a.host = b.host AND a.page_id <> b.page_id WHERE a.page_id % 50 = 0),
f AS (SELECT page_id, cand_id, norm, (e1 <> e2)::INT AS k1, -len(list_intersect(t1, t2)) AS k2,
    -len(list_filter(range(1, least(len(t1), len(t2)) + 1), lambda i: {_CLASS.format('t1[i]')} = {_CLASS.format('t2[i]')})) AS k3,
    ((len(p1) > 0) <> (len(p2) > 0))::INT AS k4, -len(list_intersect({_KEYS.format('p1')}, {_KEYS.format('p2')})) AS k5, -len(list_intersect({_VALS.format('p1')}, {_VALS.format('p2')})) AS k6
  FROM c WHERE m1 <> norm AND NOT (list_has_any(string_split_regex(lower(leaf2), '[^a-z0-9]+'), {_WORDS})
    OR (NOT (path1 IN ('', '/') AND q1 = '') AND path2 IN ('', '/') AND q2 = '') OR e2 IN ('.pdf', '.jpeg', '.jpg', '.doc'))),
once AS (SELECT *, row_number() OVER (PARTITION BY page_id, norm ORDER BY k1, k2, k3, k4, k5, k6, cand_id) AS o FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k1, k2, k3, k4, k5, k6, cand_id) AS rank FROM once WHERE o = 1)"""


def pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


#: The stated targets.
TARGETS = "page_id % 50 = 0"


def near(spark, d, targets: str = TARGETS):
    """The targets with all other pages of their hosts."""
    p = pages(spark, d)
    return B.on_host(p.where(targets), p, "page_id")


def nearest(spark, d, n: int, targets: str = TARGETS):
    """For each target its ``n`` closest pages of all on its host."""
    p = pages(spark, d)
    return B.closest(p.where(targets), p, "page_id", n)


def replacements(spark, d, targets: str = TARGETS):
    """For each target the best replacement among all pages of its host."""
    found = nearest(spark, d, 1, targets)
    return found.select("page_id", "cand_id", (-F.col("key.tokens")).cast("bigint").alias("shared"), (F.col("key.ext") == 0).alias("same_ext"))


@query("replacement_candidates", f"WITH {AROUND} SELECT page_id, cand_id, -k2 AS shared, k1 = 0 AS same_ext FROM ranked WHERE rank = 1")
def replacement_candidates(spark, d):
    """The best replacement of each target (ids divisible by 50)."""
    return replacements(spark, d)


@query("neigh_rank", f"WITH {AROUND} SELECT page_id, cand_id, rank FROM ranked WHERE rank <= 5")
def neigh_rank(spark, d):
    return nearest(spark, d, 5).select("page_id", "cand_id", F.col("rank").cast("bigint").alias("rank"))


@query("neigh_multi_target", f"WITH {AROUND} SELECT cand_id, count(*) AS n, min(rank) AS best FROM ranked WHERE rank <= 5 GROUP BY 1")
def neigh_multi_target(spark, d):
    """Pages that are neighbours of several targets."""
    return nearest(spark, d, 5).groupBy("cand_id").agg(F.count("*").alias("n"), F.min("rank").cast("bigint").alias("best"))


_UP = """list_transform(range(0, least({n}, len(ds)) + 1), lambda k: {{'level': k, 'dir': gh || '|' || array_to_string(ds[1:len(ds) - k], '/')}})"""


@query(
    "neigh_levels",
    rf"""WITH {URLS}, g AS (SELECT page_id, regexp_replace(host, '^[^.]*www[^.]*\.', '') AS gh, list_filter(string_split(regexp_replace(regexp_replace(lower(path), '/?[^/]*/?$', ''), '(/[0-9]+)+$', ''), '/'), lambda x: x <> '') AS ds FROM s),
b AS (SELECT a.dir AS dir, count(*) AS n FROM (SELECT unnest({_UP.format(n=98)}) AS a FROM g) GROUP BY 1),
t AS (SELECT page_id, a.level AS level, a.dir AS dir FROM (SELECT page_id, unnest({_UP.format(n=2)}) AS a FROM g WHERE page_id % 50 = 0)),
m AS (SELECT page_id, level, n, coalesce(min(level) FILTER (n >= 10) OVER (PARTITION BY page_id), max(level) OVER (PARTITION BY page_id)) AS pick FROM t JOIN b USING (dir))
SELECT page_id, level, n FROM m WHERE level = pick""",
)
def neigh_levels(spark, d):
    """How far up the queries (ids divisible by 50) must go to have ten pages around them."""
    p = pages(spark, d)
    return B.widen(p.where("page_id % 50 = 0"), p, "page_id")


@query(
    "backlink_closeness",
    rf"""WITH {PAIRS}, h AS (SELECT *, list_reverse(string_split(host, '.')) AS ha, list_reverse(string_split(host2, '.')) AS hb, {_KEYS.format('pairs')} AS ka, {_KEYS.format('pairs2')} AS kb FROM k)
SELECT page_id, id2, (least(len(ha), len(hb)) + common - CASE WHEN len(segs) = len(segs2) THEN 0 ELSE 2 END + len(list_intersect(ka, kb)) - len(list_filter(list_distinct(kb), lambda x: NOT list_contains(ka, x))))::BIGINT AS score FROM h""",
)
def backlink_closeness(spark, d):
    from .urls import next_on_host

    return next_on_host(spark, d).select("page_id", "id2", B.backlink_score("url", "url2").alias("score"))


@query("neigh_same_depth", f"WITH {PAIRS} SELECT page_id, id2, len(segs) = len(segs2) AS same_depth, ext = ext2 AS same_ext FROM k")
def neigh_same_depth(spark, d):
    from .urls import next_on_host

    return next_on_host(spark, d).select("page_id", "id2", U.same_depth("url", "url2").alias("same_depth"), U.same_ext("url", "url2").alias("same_ext"))
