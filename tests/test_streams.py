"""A stream ends with the rows that a batch gives."""

import pytest
from pyspark.sql import functions as F

from mendweave.sources.tables import table
from mendweave.streaming import events as E
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    table(spark, SMALL, "events").select(*(F.col(f.name).cast(f.dataType) for f in E.EVENTS)).orderBy("ts").coalesce(1).write.parquet(path)
    return path


def drain(stream, mode, name):
    spark = stream.sparkSession
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


@pytest.mark.parametrize(("name", "make"), [("tumbling", E.tumbling), ("sliding", E.sliding), ("thinned", E.thinned), ("latest", E.latest)])
def test_stream_equals_batch(spark, folder, name, make):
    digits = lambda df: df.select(*(F.round(c, 4).alias(c) if t == "double" else c for c, t in df.dtypes))
    got = drain(digits(make(E.source(spark, folder))), "complete", f"out_{name}")
    want = sorted(map(tuple, digits(make(spark.read.schema(E.EVENTS).parquet(folder))).collect()))
    assert got == want and got


def test_sessions_come_out_once_closed(spark, folder):
    got = drain(E.sessions(E.source(spark, folder)).select("user_id", "session_window.start", "n"), "append", "out_sessions")
    want = {tuple(r) for r in E.sessions(spark.read.schema(E.EVENTS).parquet(folder)).select("user_id", "session_window.start", "n").collect()}
    assert got and set(got) <= want


def test_duplicates(spark, folder):
    got = drain(E.once(E.source(spark, folder), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "append", "out_once")
    want = sorted(map(tuple, E.once(spark.read.schema(E.EVENTS).parquet(folder), ["user_id", "event_type"]).select("user_id", "event_type").collect()))
    assert got == want


def test_table_is_kept(spark, folder, tmp_path):
    E.keep_table(E.source(spark, folder), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "t" / "0")).select("user_id", "event_id").collect()))
    want = sorted(map(tuple, E.latest(spark.read.schema(E.EVENTS).parquet(folder)).select("user_id", "event_id").collect()))
    assert got == want


def test_expiry(spark, tmp_path):
    """Timers and later events both end what is not renewed; files come one by one, each with later events."""
    base = 1_700_000_000
    days = [(1, 0), (1, 2), (1, 9), (2, 1), (2, 30), (3, 3), (3, 5), (3, 6), (1, 31), (4, 40), (3, 41), (5, 60), (5, 61), (4, 75)]
    days.sort(key=lambda x: x[1])
    for k in range(0, len(days), 3):
        rows = [(i, base + d * 86400, u, "view", 1.0, "{}") for i, (u, d) in enumerate(days[k : k + 3], k)]
        spark.createDataFrame(rows, "event_id bigint, s bigint, user_id bigint, event_type string, value double, props string").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seconds = lambda rows: sorted((u, (int(t.timestamp()) - base) / 86400) for u, t in rows)
    batch = seconds(E.expired(spark.read.schema(E.EVENTS).parquet(str(tmp_path / "in")), "5 days").collect())
    assert batch == [(1, 7.0), (1, 14.0), (1, 36.0), (2, 6.0), (2, 35.0), (3, 11.0), (3, 46.0), (4, 45.0), (5, 66.0)]
    got = seconds(drain(E.expired(E.source(spark, str(tmp_path / "in")), "5 days"), "append", "out_expired"))
    assert set(got) <= set(batch) and {x for x in batch if x[1] < 60} <= set(got) and len(got) == len(set(got))


def test_aliases_are_kept(spark, tmp_path):
    """A stream of examples and targets ends with the aliases that a batch gives."""
    from mendweave.operators import programs as P

    schema = "cluster string, url string, title string, alias string"
    parts = [[("c", f"http://o.com/{k}", f"Title {k}", f"http://n.com/t/{k}" if k % 3 else None) for k in range(n, n + 4)] for n in (0, 4, 8)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    E.keep_aliases(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(300)
    got = {(r["url"], r["inferred"]) for r in P.load(spark, str(tmp_path / "t" / "2")).inferred.collect()}
    assert got == {(f"http://o.com/{k}", f"http://n.com/t/{k}") for k in range(0, 12, 3)}
