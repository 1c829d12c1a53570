"""Refreshes that arrive as a stream of files become an append-once score history and change the stored companies batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizfit.operators import store
from bizfit.operators.shared import fresh_path

DELAY = "1 hour"


def refreshes(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """company_id, seen_at, signal of each refresh, once per content key; of a stream, once within the watermark."""
    rows = events.select(F.col("user_id").alias("company_id"), F.col("ts").cast("timestamp").alias("seen_at"), "event_type", "value")
    rows = rows.withColumn("cache_key", F.left(F.sha2(F.concat_ws("|", F.col("company_id").cast("string"), "event_type", F.col("value").cast("string")), 256), F.lit(32)))
    if not events.isStreaming:
        return rows.dropDuplicates(["cache_key"])
    return rows.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["cache_key"])


def run_stream(spark: SparkSession, folder: str, schema, write: Callable[[DataFrame, int], None], files_per_batch: int = 1, name: str = "events.parquet", state: str | None = None) -> None:
    """Run the stream of refreshes over the files there are now, ``write`` once a batch, with the batch's number.

    ``state`` is the folder by which a later run, or one after a failure, goes on where
    this one stopped; without it the run stands alone. State holds the keys of the last
    DELAY only. What repeats later, or in a batch that is replayed after a failure,
    reaches ``write`` again, which must do nothing twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
    query = refreshes(stream).writeStream.foreachBatch(write).option("checkpointLocation", state or fresh_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_history(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The history of all refreshes of the stream, once per content key."""
    out = fresh_path(spark, "stream-history")
    run_stream(spark, folder, schema, lambda batch, _: store.append_scores(batch, out), files_per_batch)
    return store.history_of(spark, out, refreshes(spark.createDataFrame([], schema)).schema)


def stream_refreshes(spark: SparkSession, folder: str, schema, refresh: Callable[[DataFrame, int], None], files_per_batch: int = 1, name: str = "events.parquet", state: str | None = None) -> None:
    """Each batch's companies (company_id, once each) and its number are given to ``refresh``, which does X3 and its writes."""
    run_stream(spark, folder, schema, lambda batch, epoch: refresh(batch.select("company_id").distinct(), epoch), files_per_batch, name, state)
