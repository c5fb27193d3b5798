"""URL patterns: URLs with one part replaced by a wildcard for its class, and groups of URLs that share a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendweave.functions import urls as U
from mendweave.operators.neighbors import ancestors


def parts(url) -> Column:
    """The path segments and the sorted query pairs of a URL."""
    return F.concat(U.segments(U.path(url)), U.query_pairs(U.query(url)))


def wildcard(part) -> Column:
    """``*`` and the class of a path segment; of a query pair the key stays."""
    key = F.regexp_extract(part, r"^([^=]+=)", 1)
    value = F.regexp_replace(part, r"^[^=]+=", "")
    return F.when(part.rlike("^[^=]+="), F.concat(key, F.lit("*"), U.alnum_class(value))).otherwise(F.concat(F.lit("*"), U.alnum_class(part)))


def generate(url, max_diff: int = 1) -> Column:
    """array<string>: host and parts joined by ``|``, with every combination of ``max_diff`` parts as wildcards.

    Combinations with replacement, so that of two both may be the same part; each pattern occurs once.
    """

    def of(p: Column) -> Column:
        host = U.bare_host(url)
        one = lambda xs, i: F.transform(xs, lambda x, j: F.when(j == i, wildcard(x)).otherwise(x))
        index = F.sequence(F.lit(0), F.size(p) - 1)
        if max_diff == 1:
            made = F.transform(index, lambda i: one(p, i))
        else:
            made = F.flatten(F.transform(index, lambda i: F.transform(F.sequence(i, F.size(p) - 1), lambda j: F.transform(p, lambda x, k: F.when((k == i) | (k == j), wildcard(x)).otherwise(x)))))
        return F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(made, lambda m: F.concat_ws("|", host, F.array_join(m, "|")))))

    return F.get(F.transform(F.array(parts(url)), of), 0)


def index(urls: DataFrame, id_col: str, url: str = "url", max_diff: int = 1) -> DataFrame:
    """(id, pattern)."""
    return urls.select(id_col, F.explode(generate(url, max_diff)).alias("pattern"))


def groups(indexed: DataFrame, id_col: str, least: int = 2) -> DataFrame:
    """(pattern, n, first, last) of patterns with at least so many URLs; of patterns with the same URLs the first stays.

    Two sets of ids count as the same if their sizes, their ends and two sums of their hashes agree, 128 bits; no set is
    gathered in one row.
    """
    digest = F.struct(F.bit_xor(F.xxhash64(id_col)), F.sum(F.xxhash64(F.lit(1), id_col).cast("decimal(38,0)")))
    found = indexed.groupBy("pattern").agg(F.countDistinct(id_col).alias("n"), F.min(id_col).alias("first"), F.max(id_col).alias("last"), digest.alias("x"))
    return found.where(F.col("n") >= least).groupBy("n", "first", "last", "x").agg(F.min("pattern").alias("pattern")).select("pattern", "n", "first", "last")


def match(indexed: DataFrame, queries: DataFrame, id_col: str, least: int = 2, ext: str | None = None) -> DataFrame:
    """(query, pattern, n): the patterns of the queries that so many other URLs share; given the column ``ext``, those with the same
    extension."""
    same = ["pattern"] if ext is None else ["pattern", ext]
    q = queries.select(F.col(id_col).alias("query"), *same)
    met = q.join(indexed.select(F.col(id_col).alias("other"), *same), same).where("query <> other")
    return met.groupBy("query", "pattern").agg(F.countDistinct("other").alias("n")).where(F.col("n") >= least)


def popped(indexed: DataFrame, matches: DataFrame) -> DataFrame:
    """The index without the patterns that were matched."""
    return indexed.join(matches.select("pattern").distinct(), "pattern", "left_anti")


def value_counts(urls: DataFrame, url: str = "url") -> DataFrame:
    """(section, value, n): query values within a section of a site."""
    own = urls.select(U.netloc_dir(url).alias("section"), F.explode(U.query_values(U.query(url))).alias("value"))
    return own.groupBy("section", "value").agg(F.count("*").alias("n"))


def unique_tokens(urls: DataFrame, id_col: str, url: str = "url") -> DataFrame:
    """(id, tokens): path segments that no other URL of the host has, if good as search terms; long ones first."""
    own = urls.select(id_col, U.host(url).alias("host"), F.explode(F.array_distinct(U.segments(F.lower(U.path(url))))).alias("token"))
    counts = own.groupBy("host", "token").agg(F.count("*").alias("n")).where("n = 1")
    kept = own.join(counts, ["host", "token"]).where(U.good_token("token"))
    order = F.array_sort(F.collect_list(F.struct((-F.length("token")).alias("l"), "token")))
    return kept.groupBy(id_col).agg(F.array_join(F.transform(order, lambda x: x["token"]), " ").alias("tokens"))


def redirected(targets: DataFrame, redirects: DataFrame, id_col: str, url: str = "url", levels: int = 2, least: int = 2, max_diff: int = 2) -> DataFrame:
    """(id, level, pattern, n): patterns of a target that redirecting URLs near it share, ``least`` at least and with its extension.

    Near is below the target's directory, or, only if no other URL redirects there, below the one above it, and so on for
    ``levels`` directories. The directories are probed level by level by the first and last URL of each, so that no pair of a
    target and a redirect is made before their patterns meet.
    """
    own = redirects.select(F.col(url).alias("__r"), U.match_key(url).alias("__rk")).dropDuplicates(["__rk"])
    below = own.select("__rk", F.explode(ancestors(F.col("__r"), 99)).alias("a")).select("__rk", F.col("a.dir").alias("dir"))
    ends = below.groupBy("dir").agg(F.min("__rk").alias("lo"), F.max("__rk").alias("hi"))
    t = targets.select(F.col(id_col), F.col(url), U.match_key(url).alias("__key"), F.explode(ancestors(F.col(url), levels)).alias("a")).select(id_col, url, "__key", "a.level", "a.dir")
    there = t.join(ends, "dir").where((F.col("lo") != F.col("__key")) | (F.col("hi") != F.col("__key")))
    level = there.groupBy(id_col).agg(F.min(F.struct("level", "dir", "__key")).alias("x")).select(id_col, "x.*")
    mine = targets.select(F.col(id_col), U.extension(U.path(url)).alias("ext"), F.explode(generate(url, max_diff)).alias("pattern")).join(level, id_col)
    theirs = own.select("__rk", U.extension(U.path(F.col("__r"))).alias("ext"), F.transform(ancestors(F.col("__r"), 99), lambda a: a["dir"]).alias("dirs"), F.explode(generate(F.col("__r"), max_diff)).alias("pattern"))
    met = mine.join(theirs, ["pattern", "ext"]).where(F.array_contains("dirs", F.col("dir")) & (F.col("__rk") != F.col("__key")))
    return met.groupBy(id_col, "level", "pattern").agg(F.countDistinct("__rk").alias("n")).where(F.col("n") >= least)
