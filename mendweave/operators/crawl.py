"""What decides whether and how pages are fetched, over recorded answers: content types, proxies, sitemaps, technologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendweave.functions import urls as U
from mendweave.operators import ordered

#: Categories of a site's technologies that count, by their number in a probe's answer.
CATEGORIES = {1: "CMS", 18: "Web frameworks", 22: "Web servers", 27: "Programming Languages", 34: "Databases", 62: "Paas"}
PROBE = "technologies array<struct<name string, categories array<struct<id int>>>>"


def readable(url, status, content_type) -> Column:
    """A page's answer that is kept: no error, HTML, and not a PDF by its URL."""
    return F.coalesce((F.col(status).cast("int") < 400) & F.lower(content_type).contains("html") & (U.extension(U.path(url)) != ".pdf"), F.lit(False))


def assigned(urls: DataFrame, proxies: list[str], order: list[str], fixed: int | None = None) -> DataFrame:
    """``urls`` with proxy: each in turn by the order, or always that with the number ``fixed``."""
    names = F.array(*map(F.lit, proxies))
    if fixed is not None:
        return urls.withColumn("proxy", F.lit(proxies[fixed % len(proxies)]))
    return ordered.ranked(urls, *order, rank="__rank").withColumn("proxy", F.get(names, F.pmod("__rank", F.lit(len(proxies))).cast("int"))).drop("__rank")


def sitemaps(hosts: DataFrame, robots: DataFrame, answers: DataFrame) -> DataFrame:
    """(host, sitemap): those that a host's robots file (host, text) names, else its usual one if it answers (url, status)."""
    lines = F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    named = robots.select("host", F.explode(lines).alias("sitemap")).distinct()
    usual = hosts.select("host", F.concat(F.lit("http://"), "host", F.lit("/sitemap.xml")).alias("sitemap")).distinct()
    there = answers.where(F.col("status").cast("int") < 400).select(F.col("url").alias("sitemap")).distinct()
    rest = usual.join(named.select("host").distinct(), "host", "left_anti").join(there, "sitemap", "left_semi")
    return hosts.select("host").distinct().join(named.unionByName(rest.select("host", "sitemap")), "host")


def technologies(probes: DataFrame, id_col: str, answer: str) -> DataFrame:
    """(id, category, names): a probe's technologies by the categories that count, sorted."""
    each = probes.select(id_col, F.explode(F.from_json(answer, PROBE)["technologies"]).alias("t")).select(id_col, "t.name", F.explode("t.categories").alias("c"))
    known = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    kept = each.where(F.col("c.id").isin(*CATEGORIES)).select(id_col, F.try_element_at(known, F.col("c.id")).alias("category"), "name")
    return kept.groupBy(id_col, "category").agg(F.array_sort(F.collect_set("name")).alias("names"))


def moved_alias(pages: DataFrame, url: str = "url", final: str = "final_url", canonical: str = "canonical") -> DataFrame:
    """(url, alias) of pages that work and lead elsewhere: the canonical URL of where they lead, else that itself.

    ``canonical`` is that of the final page.
    """
    moved = pages.where(F.col(final).isNotNull() & (U.match_key(url) != U.match_key(final)))
    return moved.select(url, F.coalesce(canonical, final).alias("alias"))
