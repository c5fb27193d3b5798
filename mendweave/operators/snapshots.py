"""Snapshots of URLs in time: as-of look-ups, thinning, representatives, redirect histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendweave.functions import urls as U

#: How a snapshot is chosen for a wanted time.
POLICIES = ("closest", "later", "earlier", "latest", "earliest")


def as_of(wanted: DataFrame, snaps: DataFrame, key: str, at: str, ts: str, id_col: str, policy: str = "closest") -> DataFrame:
    """For each row of ``wanted`` (key, at) the id of its snapshot; of equally good ones the smallest id.

    ``later`` falls back to the last snapshot and ``earlier`` to the first. One equi-join on the key with an aggregate
    above it: no row meets another key's snapshots.
    """
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.col(at), F.col(ts)))
    sec = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(ts))
    order = {
        "closest": F.struct(gap, F.col(id_col)),
        "later": F.struct(F.when(F.col(ts) >= F.col(at), 0).otherwise(1), F.when(F.col(ts) >= F.col(at), sec).otherwise(-sec), F.col(id_col)),
        "earlier": F.struct(F.when(F.col(ts) <= F.col(at), 0).otherwise(1), F.when(F.col(ts) <= F.col(at), -sec).otherwise(sec), F.col(id_col)),
        "latest": F.struct(-sec, F.col(id_col)),
        "earliest": F.struct(sec, F.col(id_col)),
    }[policy]
    met = wanted.join(snaps.select(key, F.col(ts), F.col(id_col)), key)
    return met.groupBy(*wanted.columns).agg(F.min_by(id_col, order).alias(id_col))


def collapse(snaps: DataFrame, key: str, ts: str, id_col: str, unit: str = "day") -> DataFrame:
    """The first snapshot of each URL and day (or another unit)."""
    return snaps.groupBy(key, F.date_trunc(unit, ts).alias("unit")).agg(F.min_by(id_col, F.struct(F.col(ts), F.col(id_col))).alias(id_col))


def ts_arrays(snaps: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    """Sorted times of good snapshots (2xx), and of those and redirects (2xx and 3xx)."""
    good, any_ = F.col(status).startswith("2"), F.col(status).rlike("^[23]")
    return snaps.groupBy(key).agg(F.array_sort(F.collect_list(F.when(good, F.col(ts)))).alias("ts"), F.array_sort(F.collect_list(F.when(any_, F.col(ts)))).alias("ts_nb"))


def representative(snaps: DataFrame, key: str, ts: str, size: str, id_col: str, days: int = 180) -> DataFrame:
    """Of the last three snapshots within ``days`` of the last, that of median size; of two the smaller."""
    last = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(id_col))
    recent = snaps.withColumn("__k", F.row_number().over(last)).withColumn("__last", F.max(ts).over(Window.partitionBy(key)))
    three = recent.where((F.col("__k") <= 3) & (F.col(ts) >= F.col("__last") - F.expr(f"INTERVAL {days} DAYS")))
    own = Window.partitionBy(key)
    ranked = three.withColumn("__r", F.row_number().over(own.orderBy(size, id_col))).withColumn("__n", F.count("*").over(own))
    return ranked.where(F.col("__r") == ((F.col("__n") - 1) / 2).cast("int") + 1).select(key, id_col)


def thin(times: Column, gap_seconds: int) -> Column:
    """Of a sorted array of seconds those that lie at least a gap after the last one kept."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(times, start, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= gap_seconds), F.concat(kept, F.array(t))).otherwise(kept))


def monthly(snaps: DataFrame, key: str, ts: str, id_col: str, unit: str = "month") -> DataFrame:
    """At most one snapshot a month (or another unit), the first."""
    own = Window.partitionBy(key, F.date_trunc(unit, ts)).orderBy(ts, id_col)
    return snaps.withColumn("__k", F.row_number().over(own)).where("__k = 1").drop("__k")


def before_break(snaps: DataFrame, key: str, ts: str, broken: Column) -> DataFrame:
    """Snapshots before the first broken one; all of a URL that never breaks."""
    cut = F.min(F.when(broken, F.col(ts))).over(Window.partitionBy(key))
    return snaps.withColumn("__cut", cut).where(F.col("__cut").isNull() | (F.col(ts) < F.col("__cut"))).drop("__cut")


def first_dropped(snaps: DataFrame, key: str, ts: str, linked: Column, id_col: str, unit: str = "month") -> DataFrame:
    """In monthly snapshots after the first with the link, the first one without it."""
    one = monthly(snaps.withColumn("__linked", linked), key, ts, id_col, unit)
    own = Window.partitionBy(key).orderBy(ts, id_col)
    seen = F.max(F.col("__linked").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return one.withColumn("__seen", seen).where("__seen = 1 AND NOT __linked").groupBy(key).agg(F.min_by(id_col, F.struct(F.col(ts), F.col(id_col))).alias(id_col))


def redirects_back(snaps: DataFrame, key: str, ts: str, status: str, days: int = 90) -> DataFrame:
    """The redirecting snapshots met when walking back from the newest and skipping those within ``days`` of the last met.

    Others do not move the mark. (key, n, oldest): how many, and the time of the oldest.
    """
    sec = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(ts))
    walk = F.reverse(F.array_sort(F.collect_list(F.struct(sec.alias("s"), F.col(status).startswith("3").alias("r")))))
    rows = snaps.groupBy(key).agg(walk.alias("w"))
    start = F.array().cast("array<bigint>")
    gap = days * 86400
    met = F.aggregate("w", start, lambda kept, x: F.when(x["r"] & ((F.size(kept) == 0) | (F.element_at(kept, -1) - x["s"] > gap)), F.concat(kept, F.array(x["s"]))).otherwise(kept))
    return rows.select(key, met.alias("m")).where("size(m) > 0").select(key, F.size("m").cast("bigint").alias("n"), F.element_at("m", -1).alias("oldest"))


def shared_targets(chains: DataFrame, url: str, neighbor: str, targets: str, near_targets: str) -> DataFrame:
    """Redirects of a URL that a neighbour leads to as well: then the target is a catch-all, not a replacement."""
    return chains.select(url, neighbor, F.arrays_overlap(targets, near_targets).alias("shared"))


def url_key(url) -> Column:
    """The form by which snapshot indexes sort URLs, here host, path and query, without scheme and www."""
    return U.norm(url, ignore_scheme=True, trim_www=True)


def under_prefixes(rows: DataFrame, prefixes: DataFrame, key: str = "key", prefix: str = "prefix") -> DataFrame:
    """``rows`` with each of the prefixes that their key begins with: one scan for all prefixes.

    A prefix falls into the bin of its beginning whose length is the largest power of two in its own. Rows enter the bins of
    those lengths, which are few, and meet the prefixes by equal bins, so a row is compared with prefixes that begin like it only.
    """
    own = prefixes.select(prefix).distinct().withColumn("__n", F.pow(F.lit(2), F.floor(F.log2(F.length(prefix)))).cast("int"))
    own = own.where(F.length(prefix) > 0).withColumn("__bin", F.expr(f"left({prefix}, __n)"))
    sizes = sorted(r["__n"] for r in own.select("__n").distinct().collect())  # as many as a length has doublings
    if not sizes:
        return rows.limit(0).withColumn(prefix, F.lit(""))
    each = rows.withColumn("__n", F.explode(F.array(*map(F.lit, sizes)))).where(F.length(key) >= F.col("__n")).withColumn("__bin", F.expr(f"left({key}, __n)"))
    return each.join(own, ["__n", "__bin"]).where(F.startswith(F.col(key), F.col(prefix))).drop("__n", "__bin")


def bucket(key, buckets: int) -> Column:
    """The part of a written index that a key's host lies in."""
    return F.pmod(F.crc32(F.regexp_extract(key, "^([^/?]*)", 1)), F.lit(buckets)).cast("int")


def write_index(snaps: DataFrame, folder: str, buckets: int = 64, key: str = "key") -> None:
    """A snapshot index as files parted by host and sorted by key within."""
    own = snaps.withColumn("bucket", bucket(F.col(key), buckets))
    own.repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(folder)


def scan_index(spark, folder: str, prefixes: DataFrame, buckets: int = 64, key: str = "key", prefix: str = "prefix") -> DataFrame:
    """The rows of a written index below the prefixes, which hold whole hosts; parts without one of their hosts are not read."""
    wanted = sorted(r["b"] for r in prefixes.select(bucket(F.col(prefix), buckets).alias("b")).distinct().collect())  # ``buckets`` at most
    return under_prefixes(spark.read.parquet(folder).where(F.col("bucket").isin(wanted)), prefixes, key, prefix)
