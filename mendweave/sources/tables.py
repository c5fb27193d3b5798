"""Sources and sinks: tables, job files, sheets and the ledgers' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendweave.session import share_path, spread

#: What a job file holds: groups of dead URLs.
JOB = T.StructType([T.StructField("netloc_dir", T.StringType()), T.StructField("urls", T.ArrayType(T.StringType()))])
#: Rows of a snapshot index.
CDX = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "ts", "statuscode", "mimetype")])


#: Tables of long texts: what is done with a row costs far more than to move it.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_path(spark)
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def jobs(spark: SparkSession, file: str) -> DataFrame:
    """(netloc_dir, url) of a job file, one row a URL."""
    return spark.read.schema(JOB).json(file, multiLine=True).select("netloc_dir", F.explode("urls").alias("url"))


def cdx(spark: SparkSession, file: str, sep: str = " ") -> DataFrame:
    """A snapshot index as separated text: url, ts (14 digits), statuscode, mimetype."""
    return spark.read.schema(CDX).csv(file, sep=sep)


def sheet(spark: SparkSession, file: str) -> DataFrame:
    """A CSV sheet whose first line names the columns; all are strings, an empty cell is null."""
    rows = spark.read.csv(file, header=True)  # the reader splits and unquotes the names; without a schema all are strings
    return rows.toDF(*(c.strip() for c in rows.columns))


def write_results(found: DataFrame, folder: str) -> None:
    """(netloc_dir, aliases) as JSON lines; ``found`` has netloc_dir, url, title, alias and reason."""
    rows = found.groupBy("netloc_dir").agg(F.array_sort(F.collect_list(F.struct("url", "title", "alias", "reason"))).alias("aliases"))
    rows.write.mode("overwrite").json(folder)


def write_bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its key, so that later joins and aggregates on it need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that break a unique index, with the number of their rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
