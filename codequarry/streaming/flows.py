"""Structured Streaming: rolling trace statistics, and index documents merged as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.plans.catalog import IndexStore
from codequarry.schema import TRACE
from codequarry.sources import documents


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(TRACE).json(folder)


def rolling_stats(stream: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Statistics of each phase by window of start time; rows later than the watermark are left out."""
    timed = stream.withColumn("at", F.timestamp_micros((F.col("start_ns") / 1000).cast("long"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "phase").agg(F.count("*").alias("n"), F.sum("duration_ns").alias("total_ns"), F.max("duration_ns").alias("max_ns"))


def merge_stream(spark: SparkSession, folder: str, store: IndexStore, variant: str, checkpoint: str) -> StreamingQuery:
    """Each batch of index documents is merged; the files of a document count as main, so that a batch
    that comes again after a failure replaces its rows by the same. Other versions are refused."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.where(~F.col("version").eqNullSafe(F.lit(1))).isEmpty():
            raise ValueError("index document version is not 1")
        rows = documents.records(df, variant)
        files = rows.select("variant", "path").distinct().withColumns({"mtime_ns": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "is_main": F.lit(1)})
        store.store({"files": files, "records": rows})

    stream = spark.readStream.schema(documents.DOCUMENT).option("multiLine", True).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
