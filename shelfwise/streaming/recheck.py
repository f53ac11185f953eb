"""Re-checks of stale offers as a stream: requests meet landed visits, results are written once for each batch.

A request is (url, at); a visit is (url, http, html, rendered), as a crawler landed it. A result
goes to the folder batch=<id> of its micro-batch, which is written over if the batch is run
again after a failure, so a replay changes nothing. Offers take the latest answer of their address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.stock import checked_page

RESULT = "url string, at timestamp, status string, verified boolean, method string"


def stale_first(offers: DataFrame, checked_at: str, now: Column, stale_hours: float, most: int) -> DataFrame:
    """The queue of a re-check: offers never checked, then the longest unchecked, at most `most` (the queue's length), with their age in hours."""
    age = F.coalesce((F.unix_millis(now) - F.unix_millis(F.col(checked_at).cast("timestamp"))) / 3600000.0, F.lit(float("inf")))
    return offers.withColumn("age", age).where(F.col("age") >= stale_hours).orderBy(F.desc("age"), "url", "ord").limit(most)


def answers(requests: DataFrame, visits: DataFrame) -> DataFrame:
    """url, at, status, verified, method of every request; one without a visit tells nothing (not-visited).

    visits: one row for each address. Works on a stream of requests (a stream-static join) and on a batch.
    """
    page = checked_page(F.col("http"), F.col("html"), F.col("rendered"))
    none = F.struct(F.lit("unknown").alias("status"), F.lit(False).alias("verified"), F.lit("not-visited").alias("method"))
    seen = requests.select("url", "at").join(visits.select("url", "http", "html", "rendered", F.lit(True).alias("there")), "url", "left")
    return seen.select("url", "at", F.inline(F.array(F.when(F.col("there"), page).otherwise(none))))


def write_batches(results: DataFrame, folder: str, checkpoint: str):
    """Starts the stream of results into folder, a subfolder for each micro-batch; returns the running query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{RESULT}, batch long").parquet(folder)


def refreshed(offers: DataFrame, results: DataFrame, few: bool = False) -> DataFrame:
    """offers with stock and checked: the latest answer (by time, then batch, if there is one) of their address; an answer that is not verified leaves the stock.

    few: results are those of bounded queues, so they are sent to the offers and the offers stay where they are.
    """
    order = F.struct("at", F.col("batch") if "batch" in results.columns else F.lit(0), "status")
    last = results.groupBy("url").agg(F.max_by(F.struct("status", "verified"), order).alias("last"))
    joined = offers.join(F.broadcast(last) if few else last, "url", "left")
    return joined.withColumn("stock", F.when(F.col("last.verified"), F.col("last.status")).otherwise(F.col("stock"))).withColumn("checked", F.col("last").isNotNull()).drop("last")
