"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path

#: The ASCII letters, for lower-casing A-Z alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame, few: bool = False, **options: str | int) -> DataFrame:
    """Writes df as a table in the shared folder and returns a read of it.

    This cuts lineage and keeps a costly result from being computed twice; a
    lost executor costs a re-read, never a recomputation. It is removed when the
    driver ends. few: no more files
    than four for each core, for tables of short rows, of which a job with many
    partitions would else write a great number of tiny ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    rows = df.coalesce(4 * spark.sparkContext.defaultParallelism) if few else df
    rows.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2_000, size: str = "8m") -> None:
    """Sets how much a Python worker is handed at once. The registered queries and the pipeline's stages call it first.

    Texts differ in length by orders of magnitude, and what a worker or its
    executor held once it keeps, so batches are bounded by bytes as well as rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in the table: what the numbers of buckets follow."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
