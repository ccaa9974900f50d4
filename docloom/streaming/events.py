"""Event streams: windows, sessions, deduplication, latest status and a queue served by micro-batches.

``events(event_id, ts, user_id, event_type, value, …)``, as a stream or as a table: every function takes either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, name: str = "events*", files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder that match ``name``; event times are UTC timestamps."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value): counts and sums by window; events later than ``late`` are dropped by the watermark."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "1 day", slide: str = "12 hours", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events less than ``gap`` apart."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once; ids are remembered as long as the watermark allows them to come again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


_RUNNING = "user_id long, events long, total double, last_type string"
_KEPT = "events long, total double, last_type string, last_us long, last_id long"


def _running(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total, last, *newest = state.get if state.exists else (0, 0.0, "", -(1 << 62), -(1 << 62))
    for batch in batches:
        n, total = n + len(batch), total + float(batch["value"].sum())
        row = batch.sort_values(["ts", "event_id"]).iloc[-1]
        at = [int(row["ts"].value // 1000), int(row["event_id"])]
        # An event that comes late doesn't take the place of a newer one of an earlier micro-batch.
        if at > newest:
            newest, last = at, row["event_type"]
    state.update((n, total, last, *newest))
    yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total], "last_type": [last]})


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, events, total, last_type) of each user so far, updated with each micro-batch; streams only."""
    return events.select("user_id", "ts", "event_id", "event_type", "value").groupBy("user_id").applyInPandasWithState(
        _running, _RUNNING, _KEPT, "update", GroupStateTimeout.NoTimeout
    )


def serve(jobs: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch of pending jobs, best priority first, to ``work``. One batch runs at a time, so no row is locked."""

    def batch(df: DataFrame, epoch: int) -> None:
        work(df.where(F.col("status") == "pending").orderBy(F.col("priority").desc(), "created_at", "job_id"), epoch)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is now, into a table in memory (tests and small results), and return it."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
