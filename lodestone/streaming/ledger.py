"""The event ledger as a stream: idempotent events, windowed counts, run state with expiring leases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: str = "*.parquet", per_trigger: int = 64) -> DataFrame:
    """Files of events as they arrive in a folder."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and kind; late events within the watermark still count."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _run_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        count, _ = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "n": [count], "status": ["abandoned"]})
        return
    count, last = state.get if state.exists else (0, 0)
    for pdf in frames:
        count += len(pdf)
        last = max(last, int(pdf["ts"].max().timestamp() * 1000))
    state.update((count, last))
    state.setTimeoutTimestamp(last + 30 * 60 * 1000)
    yield pd.DataFrame({"user_id": [key[0]], "n": [count], "status": ["running"]})


def leases(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(user_id, n, status): a run is abandoned when no event of its came for half an hour of event time."""
    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(_run_state, "user_id long, n long, status string", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is now, into a table in memory."""
    name = f"drained_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
