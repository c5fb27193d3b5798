"""URL filters by the ratio of two character language models, in DataFrame functions only.

URLs that rules allow or block train one Markov model each, over the characters of host and path. A model's probability
of a character in a context of k characters is smoothed with that in the context of k - 1. For each place the longest
context counts in which the character was seen; the log ratio of the models there is told, order by order, by what each
further character of context adds, so that a URL's score is a plain sum over its substrings that the table holds. The score
is divided by the URL's length, and the limit between allow and block is calibrated on labelled URLs kept from the training.

The table holds all substrings counted. Those with at least a share of 2**-SHARE of all substrings of their length, ORDER + 1
times 2**SHARE rows at most whatever the corpus, are broadcast; the others are met by a shuffled join.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule fits it, and its score is 0.
A URL that no rule fits is allowed if its score reaches the limit; without URLs of both kinds all others are allowed.
Scores are found once for equal URLs; repeated rows and null ids stay. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, saved

#: The longest context, in characters.
ORDER = 4
SHARE = 17
#: Weight of the shorter context, in occurrences.
WEIGHT = 4.0
#: URLs whose substrings a task makes, about.
SPREAD = 5000
#: Characters that the shortest model takes as equally likely.
ALPHABET = 64.0
#: One in so many labelled URLs is kept for the calibration.
KEPT = 5

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """With host, path, rule (the longest that fits) and its verdict, both null if none does."""
    parts = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, slash, rest = text.partition("/")
        fits = ((F.col("host") == site) | F.col("host").endswith(f".{site}")) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return parts.withColumn("rule", rule).withColumn("verdict", verdict)


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """A row for each place and each length of context: k, the context and the character together as gram.

    Digits count as one character; the text is padded on the left and ends with ``$``.
    """
    padded = texts.withColumn("__p", F.concat(F.lit("^" * order), F.translate("text", "123456789", "000000000"), F.lit("$")))
    each = [f"transform(sequence({order + 1}, length(__p)), i -> struct({k} AS k, substring(__p, i - {k}, {k + 1}) AS gram))" for k in range(order + 1)]
    return padded.withColumn("__g", F.explode(F.expr(f"concat({', '.join(each)})"))).drop("__p").select(*texts.columns, "__g.k", "__g.gram")


def fit(labelled: DataFrame, order: int = ORDER, share: int = SHARE, weight: float = WEIGHT) -> DataFrame:
    """From (text, good) the table (gram, delta, often) of all substrings; often are those that may be broadcast."""
    counts = _grams(labelled, order).groupBy("k", "gram").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b"))
    counts = saved(counts)
    total = counts.where("k = 0").agg(F.sum(F.col("a") + F.col("b"))).first()[0] or 0
    counts = counts.withColumn("often", F.col("a") + F.col("b") >= total / 2.0**share)
    # the times that a context came before any character
    seen = counts.withColumn("context", F.expr("substring(gram, 1, k)")).groupBy("k", "context").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    tables, below = [], None
    for k in range(order + 1):
        own = counts.where(F.col("k") == k).withColumn("context", F.expr("substring(gram, 1, k)")).withColumn("rest", F.expr("substring(gram, 2)"))
        own = own.join(seen.where(F.col("k") == k).drop("k"), "context")
        if below is None:
            own = own.withColumn("la", F.lit(1 / ALPHABET)).withColumn("lb", F.lit(1 / ALPHABET))
        else:
            own = own.join(below.select(F.col("gram").alias("rest"), F.col("pa").alias("la"), F.col("pb").alias("lb")), "rest")
        for x in "ab":
            own = own.withColumn(f"p{x}", (F.col(x) + weight * F.col(f"l{x}")) / (F.col(f"t{x}") + weight))
        below = saved(own.select("gram", "often", "pa", "pb", (F.log("pa") - F.log("pb") - F.log("la") + F.log("lb")).alias("delta")))
        tables.append(below.select("gram", "delta", "often"))
    return reduce(DataFrame.union, tables)


def score(texts: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """Of distinct (text), the score: the mean log ratio of the models over its characters."""
    often, seldom = table.where("often").select("gram", F.col("delta").alias("known")), table.where("NOT often").select("gram", "delta")
    parts = _grams(texts, order).join(F.broadcast(often), "gram", "left")  # a proven bound: see the module's head
    # the others meet once for each text; a substring that is often has no row among them
    rest = parts.where("known IS NULL").groupBy("text", "gram").agg(F.count("*").alias("times")).join(seldom.hint("shuffle_merge"), "gram")
    each = parts.where("known IS NOT NULL").select("text", F.col("known").alias("d")).union(rest.select("text", F.col("delta") * F.col("times")))
    sums = each.groupBy("text").agg(F.sum("d").alias("s"))
    return sums.select("text", F.round(F.col("s") / (F.length("text") + 1), 9).alias("score"))


def limit_of(scored: DataFrame) -> float:
    """From (score, good) the limit at which the shares of good and bad that reach it differ most; -inf without both."""
    bins = scored.groupBy(F.round("score", 2).alias("x")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    up = Window.orderBy(F.desc("x"))  # over the bins, of which a bounded score has few
    sums = bins.select("x", F.sum("g").over(up).alias("g"), F.sum("b").over(up).alias("b"), F.sum("g").over(Window.partitionBy()).alias("ng"), F.sum("b").over(Window.partitionBy()).alias("nb"))
    best = sums.where("ng > 0 AND nb > 0").orderBy(F.desc(F.round(F.col("g") / F.col("ng") - F.col("b") / F.col("nb"), 9)), "x").limit(1).collect()
    return best[0]["x"] - 0.005 if best else float("-inf")


def _spread(texts: DataFrame) -> DataFrame:
    """Over so many tasks that each has some thousand texts, as every text becomes hundreds of rows."""
    return texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, texts.count() // SPREAD), "text")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and score of each page."""
    parts = ruled(pages.select(id_col, url), rules, url).withColumn("text", F.concat("host", "path"))
    texts = _spread(saved(parts.where("text <> ''").groupBy("text").agg(F.max("verdict").alias("verdict"))))
    labelled = texts.where("verdict IS NOT NULL").select("text", (F.col("verdict") == "allow").alias("good"), (F.pmod(F.xxhash64("text"), F.lit(KEPT)) == 0).alias("held"))
    table = fit(labelled.where("NOT held").drop("held"))
    scores = saved(score(texts.select("text"), table))
    limit = limit_of(labelled.where("held").join(scores, "text").select("score", "good"))
    own = parts.join(scores, "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return own.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


QUERIES = {"op6_url_model": op6_url_model}
