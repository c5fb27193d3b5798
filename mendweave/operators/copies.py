"""Links between texts that share most of their shingles, each counted, without a row for each shingle of each text.

Of two sets with a Jaccard similarity of at least the bound, the first ``n - ceil(bound * n) + 1`` elements of each, in any order
that holds for all sets, have one in common; only these are shuffled. The order is by the count in a sample of the texts and by
hash, so that common passages come last; the sample changes what is compared, not what is found. Pairs that meet are compared by
their whole sets in cells: a set goes to its own cell, found by its smallest hash, which sets that are alike mostly share, and once to
each other cell where it is compared, not with each pair. A cell's sets are dealt over parts of PART.

Shingles are told by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendweave.session import share_path, written

#: One in so many texts is counted for the order, and so many shingles at most come last.
SAMPLE, LATE = 16, 1 << 18
#: Sets of a cell, about; sets that are asked for by a broadcast of their ids, more are by a shuffle.
PART, BROADCAST_ROWS = 256, 500_000


def _first(threshold: float, order):
    """(key, id, n, low, first): a set's size, its smallest hash and its first hashes by the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, times = order.value
        for batch in batches:
            lists = batch.column("h")
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            firsts, lows, sizes = [], [], np.diff(at)
            for a, b in zip(at[:-1], at[1:], strict=True):
                own, n = flat[a:b], b - a
                rank = np.zeros(n, np.int64)
                if len(late) and n:
                    place = np.minimum(np.searchsorted(late, own), len(late) - 1)
                    rank = np.where(late[place] == own, times[place], 0)
                # a set of n needs ceil(threshold * n) in common with any that is alike
                firsts.append(own[np.lexsort((own, rank))[: n - math.ceil(threshold * n - 1e-9) + 1 if n else 0]])
                lows.append(int(own.min()) if n else None)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in firsts]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("key2"), batch.column("id"), pa.array(sizes.astype(np.int32)), pa.array(lows, pa.int64()), values], ["key", "key2", "id", "n", "low", "first"])

    return run


def _compared(threshold: float):
    """The pairs of a cell whose sets are alike."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        own = dict(zip(sets["v"].to_pylist(), (np.asarray(x.values) for x in sets["h"]), strict=True))
        found = []
        for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist(), strict=True):
            a, b = own[u], own[v]
            k = len(np.intersect1d(a, b, assume_unique=True))
            if k >= threshold * (len(a) + len(b) - k) - 1e-9:
                found.append((u, v))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


def links(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of all rows, and (u, v) of classes that are alike, each pair once. ``texts``: id, a bigint; key and key2, two
    hashes by which texts are equal; h, the distinct hashes of the text's shingles."""
    spark = texts.sparkSession
    share_path(spark)
    some = texts.where(F.pmod("key", F.lit(SAMPLE)) == 0).select(F.explode("h").alias("h"))
    often = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(LATE).toArrow()
    late, times = (np.asarray(often[c]).astype(np.int64) for c in ("h", "n"))
    order = spark.sparkContext.broadcast((late[np.argsort(late)], times[np.argsort(late)]))
    rows = written(texts.select("key", "key2", "id", "h").mapInArrow(_first(threshold, order), "key bigint, key2 bigint, id bigint, n int, low bigint, first array<bigint>"))
    classes = rows.groupBy("key", "key2").agg(F.min("id").alias("class_id"))
    named = written(rows.select("key", "key2", "id").join(classes, ["key", "key2"]).select("id", "key", "key2", "class_id"))
    own = rows.join(classes.select("key", "key2", F.col("class_id").alias("id")), ["key", "key2", "id"], "left_semi").dropDuplicates(["id"])
    own = written(own.select("id", "n", "low", "first"))
    # the first shingle that both have has all they have in common behind it
    heads = own.select("id", "n", F.posexplode("first").alias("at", "s")).select("s", "id", F.struct("n", (F.col("n") - F.col("at")).alias("room")).alias("x"))
    a, b = heads.select("s", F.col("id").alias("u"), F.col("x").alias("a")), heads.select("s", F.col("id").alias("v"), F.col("x").alias("b"))
    near = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9
    room = F.least("a.room", "b.room") >= threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-6
    pairs = written(a.join(b, "s").where((F.col("u") < F.col("v")) & near & room).select("u", "v").distinct())
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    held = own.select("id", "low").join(ids, "id", "left_semi")
    sizes = held.groupBy("low").agg(F.ceil(F.count("*") / PART).alias("parts"))
    home = written(held.join(sizes, "low").select("id", "low", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "parts"))
    # small groups share cells, so that a cell is not a handful of sets
    cells = home.count() // PART + 1
    cell = F.when(F.col("parts") > 1, F.xxhash64("low", "part")).otherwise(F.pmod(F.xxhash64("low"), F.lit(cells)))
    homes = home.select("id", cell.alias("cell"), F.when(F.col("parts") > 1, F.col("part")).otherwise(0).alias("part"))
    dealt = pairs.join(homes.select(F.col("id").alias("u"), "cell"), "u").join(homes.select(F.col("id").alias("v"), "part"), "v")
    dealt = written(dealt.select("u", "v", F.struct("cell", "part").alias("cell")))
    wanted = written(dealt.select(F.col("cell").alias("to"), F.explode(F.array("u", "v")).alias("id")).distinct())
    small = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda df: df
    # whole sets are made once more, of the texts that are compared alone
    sets = texts.join(small(wanted.select("id").distinct()), "id", "left_semi").join(small(wanted), "id").select("to", F.col("id").alias("v"), "h")
    met = dealt.groupBy("cell").cogroup(sets.groupBy("to"))
    return named.select("id", "class_id"), met.applyInArrow(_compared(threshold), "u bigint, v bigint")
