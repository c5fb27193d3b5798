"""Preparing lists of URLs: hygiene, blocklists, languages of sites, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendweave.functions import html as H
from mendweave.functions import urls as U


def clean_url(url: str = "url") -> Column:
    """Without fragment and without the query pairs whose key begins with ``utm``."""
    pairs = F.filter(U.query_pairs(U.query(url)), lambda p: ~F.lower(p).startswith("utm"))
    return F.concat(U.scheme(url), F.lit("://"), U.host(url), U.path(url), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def clean_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Cleaned URLs of pages; files, sign-in and log-in pages go."""
    page = ~U.extension(U.path(url)).isin(*U.NON_HTML) & ~F.lower(F.col(url)).rlike("signin|login")
    return urls.where(page).withColumn(url, clean_url(url))


def block_sites(urls: DataFrame, blocked: DataFrame, url: str = "url") -> DataFrame:
    """Without the URLs of blocked sites. Spark broadcasts the list if it is small enough."""
    return urls.withColumn("site", U.suffix_site(U.host(url))).join(blocked, "site", "left_anti")


def site_info(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """For each host the language that most of its pages declare (the first of equals), and its number of pages."""
    own = pages.select(U.host(url).alias("site"), H.lang(html).alias("language"))
    counts = own.groupBy("site", "language").agg(F.count("*").alias("n"))
    return counts.groupBy("site").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"), F.sum("n").alias("pages"))


def in_languages(urls: DataFrame, sites: DataFrame, languages: tuple[str, ...] = ("en", "de", "fr"), url: str = "url") -> DataFrame:
    """URLs of sites in the wanted languages; a site that is not known has the language ``No html`` and goes."""
    info = sites.select("site", F.coalesce("language", F.lit("No html")).alias("language"))
    known = urls.withColumn("site", U.host(url)).join(info, "site", "left")
    return known.where(F.coalesce("language", F.lit("No html")).isin(*languages))


def grouped(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct URLs by the section of the site they are in."""
    return urls.select(U.netloc_dir(url).alias("netloc_dir"), F.col(url)).distinct()


def preprocess(urls: DataFrame, pages: DataFrame, blocked: DataFrame, languages: tuple[str, ...] = ("en", "de", "fr")) -> DataFrame:
    """(netloc_dir, url): cleaned, not blocked, in the wanted languages, distinct."""
    kept = in_languages(block_sites(clean_urls(urls), blocked).drop("site"), site_info(pages), languages)
    return grouped(kept)
