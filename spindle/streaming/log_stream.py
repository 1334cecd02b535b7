"""Logs as streams (ST1 to ST3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The table as a stream; its zoneless times become timestamps, since watermarks need those."""
    path = f"{sf_dir}/{table}.parquet"
    shape = spark.read.parquet(path).schema
    import os

    folder, name = (path, "*") if os.path.isdir(path) else os.path.split(path)
    rows = spark.readStream.schema(shape).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def dedup_errors(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST1: one row per user, type and hour, as far as the watermark remembers."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    return events.withWatermark("ts", delay).select("user_id", "event_type", hour, "ts").dropDuplicatesWithinWatermark(["user_id", "event_type", "hour"])


def hourly_counts(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """ST2: events by hour and type; later ones than the delay are dropped."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def crash_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST3: runs of events of one user, closed by a pause: start, end, events and errors."""
    s = F.session_window("ts", gap)
    got = events.withWatermark("ts", gap).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("events"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
    return got.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "errors")


_RUN = "user_id long, ordinal long, errors long"


def error_streaks(events: DataFrame) -> DataFrame:
    """W7 as a stateful operator: each user's unbroken runs of errors, with state that carries over batches."""

    def step(key, frames, state):
        ordinal, streak = state.get if state.exists else (0, 0)
        out = []
        for kind in pd.concat(list(frames)).sort_values(["ts", "event_id"])["event_type"]:
            if kind == "error":
                streak += 1
            elif streak:
                out.append((key[0], ordinal, streak))
                ordinal, streak = ordinal + 1, 0
        state.update((ordinal, streak))
        yield pd.DataFrame(out, columns=["user_id", "ordinal", "errors"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    state = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("streak", T.LongType())])
    shape = T.StructType([T.StructField(c, T.LongType()) for c in ("user_id", "ordinal", "errors")])
    return events.groupBy("user_id").applyInPandasWithState(step, shape, state, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Run over what is there now, into Parquet under ``out`` in the shared folder, and read the result."""
    q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")
