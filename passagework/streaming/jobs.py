"""Structured Streaming: resumable ingestion and a sliding rate budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, kind: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Files of a folder that no earlier run has taken, transformed and appended to a table; then it stops.

    The checkpoint remembers what was taken. Each batch is written under its
    number, so one that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).format(kind).load(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stateful stream gives to a table, as far as there is input; then it stops. State is kept where its size doesn't burden executors' heaps."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_load(events: DataFrame, at: str = "ts", by: str = "event_type", window: str = "60 seconds", slide: str = "20 seconds", late: str = "2 minutes") -> DataFrame:
    """(window_start, by, n): events in each sliding window; for batches and streams alike."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    counted = rows.groupBy(F.window(at, window, slide), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), by, "n")
