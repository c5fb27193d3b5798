"""Event streams: windows, sessions, duplicates, latest state and tables kept up to date.

Each function takes a DataFrame, streaming or not: a batch gives the same rows that the stream gives in the end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from mendweave.operators import ordered, programs

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def source(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Events as Parquet files come into a folder, so many a trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return _late(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    return _late(events, delay).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    return _late(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Without the events whose key came before, in a stream within the delay."""
    return _late(events, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def thinned(events: DataFrame, width: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """One event of each user and window, the first."""
    return _late(events, delay).groupBy(F.window("ts", width), "user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each user; in a stream for complete or update mode."""
    return events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


def keep_table(events: DataFrame, path: str, checkpoint: str):
    """A table of the latest event of each user, replaced by every micro-batch.

    Versions lie in folders named by the batch, so a batch that runs again after a loss writes the same version anew from
    the one before it.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("user_id", "event_id", "ts")
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/{number - 1}"))
        newest = new.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.ts")
        newest.write.mode("overwrite").parquet(f"{path}/{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired(events: DataFrame, ttl: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """(user_id, ts): when what was fetched for a user ceased to be valid, as no event renewed it for the time ``ttl``.

    In a stream each user's last event is kept as state, and a timer goes off once the watermark passes its end; a batch gives
    all that end before a later event, and those that end before the table's last event less the delay.
    """
    long = int(pd.Timedelta(ttl).total_seconds() * 1000)
    if not events.isStreaming:
        end = events.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("__end"))
        after = ordered.followed(events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], {"next": "ts"})
        stop = F.col("ts") + F.expr(f"INTERVAL {long} MILLISECONDS")
        return after.crossJoin(F.broadcast(end)).where((stop < F.col("next")) | (F.col("next").isNull() & (stop < F.col("__end")))).select("user_id", stop.alias("ts"))  # the end is one row

    def step(key, batches, state):
        last, out = (state.get[0] if state.exists else None), []
        if state.hasTimedOut:
            out.append(last + long)
            state.remove()
        else:
            for now in sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"]):
                if last is not None and last + long < now:
                    out.append(last + long)
                last = now if last is None else max(last, now)
            if last + long > state.getCurrentWatermarkMs():
                state.update((last,))
                state.setTimeoutTimestamp(last + long)
            else:
                out.append(last + long)
                if state.exists:
                    state.remove()
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "ts": pd.to_datetime(out, unit="ms")})

    own = events.withWatermark("ts", delay).select("user_id", "ts")
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, ts timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def keep_aliases(rows: DataFrame, path: str, checkpoint: str):
    """Aliases inferred as examples and targets (cluster, url, title, alias) come in: each micro-batch advances the state of the one
    before it, so that only the clusters that it touches are inferred again.

    States lie in folders named by the batch, so a batch that runs again after a loss writes the same state anew.
    """
    spark = rows.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        state = programs.load(spark, f"{path}/{number - 1}") if number else programs.started(spark)
        after = programs.advance(state, batch.where("alias IS NOT NULL"), batch.where("alias IS NULL").drop("alias"))
        programs.save(after, f"{path}/{number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
