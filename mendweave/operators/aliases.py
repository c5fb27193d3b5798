"""Smaller operators around the search for aliases: evidence, orders, scores and preparation of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendweave.functions import text as X
from mendweave.functions import urls as U

#: Fixed value: days that a cached page stays valid.
TTL_DAYS = 30


def cached(urls: DataFrame, cache: DataFrame, now: Column, url: str = "url", fetched: str = "fetched", key: str | None = None) -> DataFrame:
    """``urls`` with hit: the cache holds them and they are not expired, or are archive URLs, which never expire.

    The cache holds URLs; given a ``key``, what has that key, so pages of one URL are held apart.
    """
    key = key or url
    own = cache.select(F.col(key).alias("__url"), F.col(fetched).alias("__at")).groupBy("__url").agg(F.max("__at").alias("__at"))
    fresh = F.col("__at").isNotNull() & (F.col(url).rlike(U.ARCHIVE) | (F.date_add("__at", TTL_DAYS) > now))
    return urls.join(own, F.col(key) == F.col("__url"), "left").withColumn("hit", fresh).drop("__url", "__at")


def snapshots(snaps: DataFrame, id_col: str, ts: str, status: str, keep: str, first, last, limit: int) -> DataFrame:
    """A snapshot index's rows by status pattern and time, the first of each day, ``limit`` a URL at most."""
    own = snaps.where(F.col(status).rlike(keep) & (F.col(ts) >= first) & (F.col(ts) < last)).withColumn("day", F.to_date(ts))
    day = own.groupBy(id_col, "day").agg(F.min(F.struct(ts, status)).alias("x")).select(id_col, "day", f"x.{status}")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("day"))
    return day.withColumn("k", rank).where(F.col("k") <= limit)


def checkable(a: str, b: str) -> Column:
    """A neighbour whose redirect can be compared: another page, the same depth, one's directory within the other's."""
    inside = F.contains(U.nondigit_dir(F.lower(U.path(a))), U.nondigit_dir(F.lower(U.path(b))))
    return (U.match_key(a) != U.match_key(b)) & inside & U.same_depth(a, b)


def verified_redirects(targets: DataFrame, neighbors: DataFrame, id_col: str, near: str, order: str, first: int = 2) -> DataFrame:
    """(id, target, ok): a redirect holds unless one of the first ``first`` neighbours that redirect leads to the same target.

    ``targets``: (id, target); ``neighbors``: (id, near, order).
    """
    met = neighbors.join(targets.select(F.col(id_col).alias(near), F.col("target").alias("__other")), near)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    few = met.withColumn("__k", rank).where(F.col("__k") <= first).groupBy(id_col).agg(F.collect_set("__other").alias("__others"))
    own = targets.join(few, id_col, "left")
    return own.select(id_col, "target", (~F.coalesce(F.array_contains("__others", F.col("target")), F.lit(False))).alias("ok"))


def counted_redirects(rows: DataFrame, id_col: str, order: list[str], match: Column, target: str, matches: int = 3, repeats: int = 5) -> DataFrame:
    """Rows in order until a URL has had ``matches`` matches or one target ``repeats`` times before."""
    own = Window.partitionBy(id_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(id_col, target).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(match.cast("int")).over(own), F.lit(0)).alias("seen")
    again = F.count("*").over(same).alias("again")
    return rows.select("*", seen, again).where((F.col("seen") < matches) & (F.col("again") < repeats))


def token_match(titles: DataFrame, tokens: DataFrame, id_col: str, site: str) -> DataFrame:
    """(query, doc, token): for each candidate the longest token of the target whose words all stand in its title.

    ``titles``: (id, site, word), a row a word; ``tokens``: (id, site, token, words).
    """
    each = tokens.select(F.col(id_col).alias("query"), site, "token", F.size("words").alias("n"), F.explode("words").alias("word"))
    met = each.join(titles.withColumnRenamed(id_col, "doc"), [site, "word"]).where("query <> doc")
    whole = met.groupBy("query", "doc", "token", "n").agg(F.count("*").alias("k")).where("k = n")
    return whole.groupBy("query", "doc").agg(F.min_by("token", F.struct(-F.length("token"), "token")).alias("token"))


def verdict(title: DataFrame, content: DataFrame) -> DataFrame:
    """(query, doc, type, score): the pair that titles tell apart, else the one that contents do; both hold (query, doc, top1)."""
    both = title.select("query", "doc", F.lit(0).alias("o"), F.lit("title").alias("type"), F.col("top1").alias("score")).union(content.select("query", "doc", F.lit(1), F.lit("content"), F.col("top1")))
    return both.groupBy("query").agg(F.min(F.struct("o", (-F.col("score")).alias("s"), "doc", "type")).alias("b")).select("query", "b.doc", "b.type", (-F.col("b.s")).alias("score"))


def alias_order(a: str, b: str) -> Column:
    """Of two ``neighbors.parts``, what orders a target's examples: same extension, queries alike, tokens of the same class."""
    x, y = F.col(a), F.col(b)
    n = F.least(F.size(x["kinds"]), F.size(y["kinds"]))
    kinds = F.size(F.filter(F.zip_with(F.slice(x["kinds"], 1, n), F.slice(y["kinds"], 1, n), lambda p, q: p == q), lambda e: e))
    keys = F.size(F.array_intersect(x["keys"], y["keys"]))
    return F.struct((x["ext"] != y["ext"]).cast("int").alias("ext"), (-keys).alias("keys"), (-kinds).alias("kinds"))


def last_tokens(url) -> Column:
    """Words of the last token and of the one before it."""
    t = U.tokens(url)
    words = lambda k: F.filter(F.split(F.coalesce(F.get(t, F.size(t) - k), F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array(words(1), words(2))


def token_overlap(a, b) -> Column:
    """Of the last two tokens of both URLs, the pair with most words in common, then fewest apart: struct<same, differ>."""
    x, y = last_tokens(a), last_tokens(b)

    def score(p: Column, q: Column) -> Column:
        same = F.size(F.array_intersect(p, q))
        return F.struct(same.alias("same"), (same - F.size(F.array_union(p, q))).alias("differ"))

    best = F.array_max(F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: score(p, q)))))
    return F.struct(best["same"].alias("same"), (-best["differ"]).alias("differ"))


def method_name(method, kind) -> Column:
    return F.concat_ws(":", method, kind)


def merged(a: Column, b: Column) -> Column:
    """A map of both; where both have a key, the second counts."""
    only = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(only, b)


def weighted_sum(a, b) -> Column:
    return 0.75 * F.col(a) + 0.25 * F.col(b)


def estimated(p, spatial) -> Column:
    return F.col(p) + (1 - F.col(p)) * F.col(spatial)


def without_index(url) -> Column:
    """A URL whose index file is cut off."""
    return F.regexp_replace(url, r"/index[^/?#]*(?=$|[?#])", "/")


def squeezed(text) -> Column:
    return X.squeeze(text)
