"""Ledgers: upserts, inserts of what is absent, expiry, merged traces; as whole-table plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds, some 3,170 years.
MOST_AGE = 10**11 - 1


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of both; where a key is in both, the new row's values that are not null win."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in rest))
    return old.join(fresh, list(keys), "full_outer").select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in rest))


def insert_absent(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows, and the new ones whose key is not there; of new rows with one key the first by all columns."""
    first = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys])
    once = new.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    return old.unionByName(once.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def latest(log: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """The last row of each key in an append log."""
    last = Window.partitionBy(*keys).orderBy(F.desc(version), *[F.desc(t) for t in ties])
    return log.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")


def pending(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def ttl(fetched: str, header: Column, least_days: int = 30) -> Column:
    """When a cached page expires: after the header's ``max-age``, but not before ``least_days``. Ages over MOST_AGE are that."""
    digits = F.nullif(F.regexp_extract(header, r"max-age=0*([0-9]+)", 1), F.lit(""))
    age = F.coalesce(F.when(F.length(digits) > 11, MOST_AGE).otherwise(digits.try_cast("bigint")), F.lit(0))
    return F.col(fetched) + F.make_dt_interval(secs=F.greatest(age, F.lit(least_days * 86400)).cast("decimal(18,6)"))


def expire(cache: DataFrame, now: Column, expires: str, *derived: str) -> DataFrame:
    """Derived columns of rows that have expired become null."""
    return cache.select(*(F.when(F.col(expires) > now, F.col(c)).alias(c) if c in derived else F.col(c) for c in cache.columns))


def merge_traces(log: DataFrame, key: str, name: str, value: str, version: str) -> DataFrame:
    """(key, name, value): the last value of each name in a URL's trace."""
    return log.groupBy(key, name).agg(F.max_by(value, version).alias(value))
