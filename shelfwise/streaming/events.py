"""Job events as streams: each function takes a streaming or a batch DataFrame alike.

The batch form is the streaming form's twin: over the same rows both give the same result
once all rows have arrived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums by type and event-time window; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(field: str, order: str):
    """The last value of a field that is not null."""
    return F.max_by(field, F.when(F.col(field).isNotNull(), F.col(order)))


def cards(events: DataFrame) -> DataFrame:
    """The latest value and type of each user and key: later non-null fields win."""
    return events.groupBy("user_id", (F.col("event_id") % 40).alias("card")).agg(latest("value", "event_id").alias("value"), latest("event_type", "event_id").alias("type"))


JOB = "user_id long, status string, n long"


def job_states(events: DataFrame, done: str = "purchase") -> DataFrame:
    """queued, running or complete for each job, one row for each change; what comes for a job
    after its end is ignored. State: status, count and the greatest event so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("queued", 0)
        for types in (t for pdf in batches for t in pdf.sort_values("event_id")["event_type"]):
            if status == "complete":
                break
            status, n = ("complete" if types == done else "running"), n + 1
        state.update((status, n))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, JOB, "status string, n long", "update", GroupStateTimeout.NoTimeout)


def job_states_batch(events: DataFrame, done: str = "purchase") -> DataFrame:
    """The batch twin of job_states' last rows."""
    end = events.where(F.col("event_type") == done).groupBy("user_id").agg(F.min("event_id").alias("end"))
    kept = events.join(end, "user_id", "left").where("end is null or event_id <= end")
    return kept.groupBy("user_id").agg(F.when(F.max("end").isNull(), "running").otherwise("complete").alias("status"), F.count(F.lit(1)).alias("n"))


def append_observations(events: DataFrame, folder: str, checkpoint: str):
    """An append-only log of observations from a stream; returns the running query."""
    rows = events.select("event_id", "ts", F.col("user_id").alias("url_id"), F.col("value").alias("price"), F.coalesce("event_type", F.lit("unknown")).alias("status"))
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
