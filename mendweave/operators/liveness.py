"""Is a URL alive? Status of a probe, and the verdict from a page and its perturbed siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendweave.functions import urls as U

#: Words of a page of at most SHORT words that tell of an error.
SHORT, ERROR_TEXT = 20, r"(?i)not found|no longer|does not exist|unavailable|404"
ALIKE = 0.9


def status(url, final_url, code, error) -> Column:
    """struct<status, detail> of a probe."""
    moved = U.match_key(url) != U.match_key(final_url)
    detail = F.when(~moved, "no redirection").when(U.is_home(final_url), "homepage redirection").when(F.col(final_url).isNull(), "unknown redirection").otherwise("non-home redirection")
    failed = F.col(error).isNotNull()
    kind = F.when(F.lower(error).rlike("dns|name or service|nodename"), "DNSError").otherwise("OtherError")
    return F.struct(F.when(failed, kind).otherwise(F.col(code).cast("string")).alias("status"), F.when(failed, F.col(error)).otherwise(F.coalesce(detail, F.lit("unknown redirection"))).alias("detail"))


def verdicts(pages: DataFrame, probes: DataFrame, key: str = "url") -> DataFrame:
    """(url, broken, reason): broken is ``true``, ``false`` or ``N/A``. With another ``key`` of both, by which pages of one URL are
    told apart, it comes first.

    ``pages``: url, allowed, status, html (whether it is), final_url, canonical. ``probes``: url, status, final_url, n_redirects,
    same_redirects, words, text, jaccard, one row for each perturbed sibling. The first rule that fits decides; the siblings
    must all say that the page is broken.
    """
    hard = F.col("status").rlike("^[45]") | F.col("status").isin("DNSError", "OtherError")
    vote = (
        F.when(F.col("p_status").rlike("^[45]") | F.col("p_status").isin("DNSError", "OtherError"), F.struct(F.lit(False).alias("b"), F.lit("Sibling is broken").alias("r")))
        .when(~F.col("same_redirects"), F.struct(F.lit(False).alias("b"), F.lit("Redirects differ").alias("r")))
        .when((F.col("n_redirects") > 0) & (F.col("p_final") == F.col("final_url")), F.struct(F.lit(True).alias("b"), F.lit("Similar redirection").alias("r")))
        .when((F.col("words") <= SHORT) & F.col("text").rlike(ERROR_TEXT), F.struct(F.lit(True).alias("b"), F.lit("Error text").alias("r")))
        .when(F.col("jaccard") >= ALIKE, F.struct(F.lit(True).alias("b"), F.lit("Similar content").alias("r")))
        .otherwise(F.struct(F.lit(False).alias("b"), F.lit("Content differs").alias("r")))
    )
    own = probes.select(F.col(key).alias("p_key"), F.col("status").alias("p_status"), F.col("final_url").alias("p_final"), "n_redirects", "same_redirects", "words", "text", "jaccard")
    met = pages.join(own, pages[key] == own["p_key"], "left")
    votes = met.withColumn("v", F.when(F.col("p_key").isNotNull(), vote)).groupBy(*pages.columns).agg(F.count("v").alias("n"), F.bool_and("v.b").alias("all_"), F.array_join(F.array_sort(F.collect_set("v.r")), "; ").alias("rs"))
    broken = (
        F.when(~F.col("allowed"), "N/A").when(hard, "true").when(~F.col("html"), "N/A").when(U.is_home("url"), "false")
        .when(U.is_home("final_url"), "true").when(F.col("canonical").isNotNull() & (U.match_key("canonical") == U.match_key("url")), "false")
        .when(F.col("n") == 0, "N/A").otherwise(F.col("all_").cast("string"))
    )
    reason = (
        F.when(~F.col("allowed"), "Not allowed").when(hard, F.col("status")).when(~F.col("html"), "Not html").when(U.is_home("url"), "Homepage")
        .when(U.is_home("final_url"), "Redirected to homepage").when(F.col("canonical").isNotNull() & (U.match_key("canonical") == U.match_key("url")), "Canonical")
        .when(F.col("n") == 0, "No probe").otherwise(F.col("rs"))
    )
    return votes.select(*dict.fromkeys([key, "url"]), broken.alias("broken"), reason.alias("reason"))


def real_hops(hops) -> Column:
    """A redirect chain (array of URLs) without the steps that only change the scheme."""
    bare = lambda u: F.regexp_replace(u, "^https?://", "")
    return F.filter(hops, lambda u, i: (i == 0) | (bare(u) != bare(F.get(hops, i - 1))))


def allowed(urls: DataFrame, robots: DataFrame, url: str = "url", answers: DataFrame | None = None) -> DataFrame:
    """With allowed: no rule (host, disallow) of the URL's host is the beginning of its path.

    Given the answers (host, status) to the hosts' robots files, rules of those that failed, with 400 or more, do not count.
    """
    if answers is not None:
        robots = robots.join(answers.where(F.col("status").cast("int") >= 400).select("host").distinct(), "host", "left_anti")
    own = urls.withColumn("__h", U.host(url)).withColumn("__p", U.path(url))
    hit = own.join(robots, (F.col("__h") == F.col("host")) & F.startswith("__p", F.col("disallow")) & (F.col("disallow") != ""), "left_semi").select(url).distinct().withColumn("__no", F.lit(True))
    return urls.join(hit, url, "left").withColumn("allowed", F.col("__no").isNull()).drop("__no")


def perturb(url) -> Column:
    """A sibling's URL that should not exist: the file name with its letters and digits replaced, the same each time.

    Letters and digits are shifted by an amount taken from a hash of the URL, so the form stays.
    """
    k = F.pmod(F.conv(F.left(F.md5(F.col(url).cast("binary")), F.lit(8)), 16, 10).cast("bigint"), F.lit(7)) + 3
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    turned = lambda s: F.concat(F.substr(F.lit(s), (k + 1).cast("int")), F.left(F.lit(s), k.cast("int")))
    leaf = U.filename(U.path(url))
    return F.concat(U.scheme(url), F.lit("://"), U.host(url), F.regexp_replace(U.path(url), r"[^/]*/?$", ""), F.call_function("translate", leaf, F.lit(lower + upper + digits), F.concat(turned(lower), turned(upper), turned(digits))))
