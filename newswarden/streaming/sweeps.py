"""Streams of articles, observations and alerts.

Triggers: `available_now` drains what is there and ends, as one sweep does; an
interval starts the next sweep when the last has ended. Exactly once: offsets are in
the checkpoint, and what a batch writes is keyed by its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..context import DEFAULT, Context
from ..operators import filtering


def source(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def filtered(articles: DataFrame, context: Context = DEFAULT) -> DataFrame:
    """Decisions of new articles; the first of each address counts."""
    seen = articles.dropDuplicates(["id"]) if not articles.isStreaming else articles.withColumn("__at", F.col("fetched_at").cast("timestamp")).withWatermark("__at", "14 days").dropDuplicatesWithinWatermark(["id"]).drop("__at")
    return filtering.decide(seen, context)


def observed(events: DataFrame, late: str = "2 minutes", window: str = "1 day") -> DataFrame:
    """Counts and highest value by source and window; rows later than the watermark are left out."""
    at = events.withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp")).withWatermark("retrieved_at", late)
    return at.groupBy(F.window("retrieved_at", window), "source").agg(F.count("*").alias("n"), F.max("value").alias("highest"))


def merged_by(table_path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A sink that merges each batch into a snapshot and writes the next one beside it.

    The snapshot of batch n is `table_path`/v=n, made from the last one before n, so a
    batch that is run again writes the same snapshot again. The last `keep` snapshots
    stay, for readers and for a batch that is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")] if fs.exists(path) else []
        before = [v for v in there if v < number]
        old = spark.read.parquet(f"{table_path}/v={max(before)}") if before else batch.limit(0)
        merge(old, batch).write.mode("overwrite").parquet(f"{table_path}/v={number}")
        for v in sorted(before)[: -max(keep - 1, 1)]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/v={v}"), True)

    return write


def latest_snapshot(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.parquet(table_path).where(F.col("v") == spark.read.parquet(table_path).agg(F.max("v")).first()[0]).drop("v")


def started(writer: DataStreamWriter, checkpoint: str, interval: str | None = None):
    """One sweep over what is there, or a sweep every `interval` without overlap."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
