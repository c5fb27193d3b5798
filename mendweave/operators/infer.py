"""Input of the inference in long form; the inference itself is in ``programs``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendweave.functions import text as X
from mendweave.functions import urls as U


def sheet(rows: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """Long form of the input: (cluster, url, col, value) for path segments, query values and the title."""
    cells = F.concat(
        F.transform(U.segments(U.path(url)), lambda s, i: F.struct(F.concat(F.lit("Url"), i.cast("string")).alias("col"), s.alias("value"))),
        F.transform(U.query_pairs(U.query(url)), lambda p: F.struct(F.concat(F.lit("Query_"), F.regexp_extract(p, "^([^=]+)=", 1)).alias("col"), F.regexp_extract(p, "^[^=]+=(.*)$", 1).alias("value"))),
        F.array(F.struct(F.lit("Meta0").alias("col"), X.plain_title(title).alias("value"))),
    )
    return rows.select("cluster", url, F.explode(cells).alias("c")).select("cluster", url, "c.col", "c.value")
