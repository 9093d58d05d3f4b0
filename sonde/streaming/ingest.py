"""Incremental ingestion: new telemetry files become partitioned Parquet, each file once.

The chunked file reading of a batch tool maps to a file stream that is run until it has
caught up (``availableNow``); the checkpoint remembers which files were read.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions import scalars as S

LONG_METRIC = T.StructType([T.StructField(c, T.StringType()) for c in ("timestamp", "cmdb_id", "kpi_name", "value")])


def metric_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000):
    """Long metric files under ``folder`` as a stream in the unified form; unreadable rows are dropped."""
    raw = (spark.readStream.schema(LONG_METRIC).option("header", True).option("maxFilesPerTrigger", files_per_batch)
           .option("recursiveFileLookup", True).csv(folder))
    ts = S.normalise_epoch(F.col("timestamp"))
    return raw.select(
        F.col("cmdb_id").alias("component"), F.col("kpi_name").alias("kpi"), F.floor(ts / 86400).cast("bigint").alias("day"),
        ts.alias("ts"), F.col("value").try_cast("double").alias("value")).filter("ts IS NOT NULL AND value IS NOT NULL")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Append all files not read yet to ``target``, partitioned by day, and return when caught up."""
    query = (metric_stream(spark, folder).writeStream.format("parquet").partitionBy("day").outputMode("append")
             .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
