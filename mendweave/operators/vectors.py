"""The nearest vectors of stated queries, by matrix products: queries go out in blocks of a fixed size, and all vectors are read once for
each block. A task keeps the best of its vectors for each query, so what is shuffled does not grow with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendweave.session import share_path, written

#: Queries of a block, and products that a task holds at a time.
BLOCK, CELLS = 4096, 1 << 22


def _unit(column: pa.ListArray) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _best(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, points = block.value
        scores, ids = np.full((len(own), 0), -np.inf), np.zeros((len(own), 0), np.int64)
        for batch in batches:
            x, names = _unit(batch.column("v")), batch.column("id").to_numpy()
            step = max(1, CELLS // max(1, len(own)))
            for lo in range(0, len(x), step):
                dot = points @ x[lo : lo + step].T
                dot[own[:, None] == names[None, lo : lo + step]] = -np.inf
                all_scores = np.concatenate((scores, dot), axis=1)
                all_ids = np.concatenate((ids, np.broadcast_to(names[lo : lo + step], dot.shape)), axis=1)
                order = np.lexsort((all_ids, -np.round(all_scores, 9)), axis=1)[:, :k]
                scores, ids = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
        row, col = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[row, col]), pa.array(scores[row, col])], ["query", "doc", "cosine"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query, doc, cosine, rank): the ``k`` vectors nearest to each query but itself, by cosine; of equally near ones the least id.

    Vectors without a direction, null, zero or with parts that are null or not finite, are near none. ``queries`` are some of
    ``vectors``; ids are bigint.
    """
    spark = vectors.sparkSession
    share_path(spark)
    sound = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    kept = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(sound)
    asked, own = written(kept(queries).distinct()), kept(vectors)
    found = None
    for size, n in sorted((r["d"], r["n"]) for r in asked.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):  # a row a length of vector
        blocks = -(-n // block)
        same = asked.where(F.size("v") == size).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        for b in range(blocks):
            rows = same.where(F.col("b") == b).orderBy("id").toArrow()  # about ``block`` rows
            if rows.num_rows:
                sent = spark.sparkContext.broadcast((rows["id"].to_numpy(), _unit(rows["v"].combine_chunks())))
                part = own.where(F.size("v") == size).mapInArrow(_best(sent, k), "query bigint, doc bigint, cosine double")
                found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query bigint, doc bigint, cosine double, rank bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "doc"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
