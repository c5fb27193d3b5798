"""Rows beside a row in a sort order, without a window over a whole group: however many rows a group has, no task sorts them all.

Rows are parted by ranges of the order. Their counts, one for each partition, turn the place in a partition into a rank in
the whole table. Ranks are cut into blocks of a fixed size; a block also gets the rows just outside its borders, and a window
over one block finds what is beside its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendweave.session import written

#: Rows of a block.
BLOCK = 1 << 14


def ranked(rows: DataFrame, *order: str, rank: str = "rank") -> DataFrame:
    """``rows`` with their place in the order, from 0; rows that are equal in it get any order among them."""
    at = F.monotonically_increasing_id()  # the partition, and the place in it
    parted = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    sizes = parted.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", before.alias("__start"))
    own = parted.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return own.withColumn(rank, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__start")


def beside(rows: DataFrame, reach: int, columns: dict[str, Column], rank: str = "rank", block: int = BLOCK) -> DataFrame:
    """``rows``, ranked, with window columns that look at most ``reach`` ranks away; give each by ``over()``."""
    block = max(block, reach)
    first, last = F.greatest(F.floor((F.col(rank) - reach) / block), F.lit(0)), F.floor((F.col(rank) + reach) / block)
    dealt = rows.withColumn("__block", F.explode(F.sequence(first, last)))
    return dealt.withColumns(columns).where(F.col("__block") == F.floor(F.col(rank) / block)).drop("__block")


def over(rank: str = "rank"):
    """The window of the columns for ``beside``."""
    return Window.partitionBy("__block").orderBy(rank)


def followed(rows: DataFrame, group: list[str], order: list[str], columns: dict[str, str], steps: int = 1, block: int = BLOCK) -> DataFrame:
    """``rows`` with columns of the row ``steps`` further in the order of their group, null where the group has none.

    ``columns``: the new names and what they are taken from.
    """
    own = ranked(rows, *group, *order, rank="__rank")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.lead(g, steps).over(over("__rank")))
    return beside(own, abs(steps), {new: F.when(same, F.lead(c, steps).over(over("__rank"))) for new, c in columns.items()}, "__rank", block).drop("__rank")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in the order of their group, from 1."""
    own = ranked(rows, *group, *order, rank="__rank")
    first = own.groupBy(*group).agg(F.min("__rank").alias("__first"))
    return own.join(first, group).withColumn(name, F.col("__rank") - F.col("__first") + 1).drop("__rank", "__first")


def nearest(rows: DataFrame, row: Column, fair, score, n: int, reach: int, rank: str = "rank", block: int = BLOCK) -> DataFrame:
    """``rows``, ranked, with near: of the rows up to ``reach`` ranks away those that are ``fair``, the ``n`` with the least ``score``.

    ``row`` is the struct of a neighbour; ``fair`` and ``score`` take it, and may use the row's own columns. Of equal scores
    the nearer rank counts, then the earlier.
    """
    other = F.struct(F.col(rank).alias("at"), row.alias("row"))
    around = F.concat(F.collect_list(other).over(over(rank).rowsBetween(-reach, -1)), F.collect_list(other).over(over(rank).rowsBetween(1, reach)))
    met = beside(rows, reach, {"__around": around}, rank, block)
    kept = F.filter("__around", lambda x: fair(x["row"]))
    order = F.array_sort(F.transform(kept, lambda x: F.struct(score(x["row"]).alias("score"), F.abs(x["at"] - F.col(rank)).alias("away"), x["at"].alias("at"), x["row"].alias("row"))))
    return met.withColumn("near", F.transform(F.slice(order, 1, n), lambda x: x["row"])).drop("__around")
