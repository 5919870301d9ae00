"""Structured Streaming over folders of JSON Lines: the batch mapping, then an upsert by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.records import map_any_line
from codestrata.sources.bucketed import BucketedTable
from codestrata.sources.files import upsert


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Records of new files of ``folder``; malformed lines are skipped."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return map_any_line(raw.filter("trim(value) != ''"), "value")


def upsert_stream(records: DataFrame, table: str, checkpoint: str):
    """Start the stream into the table at ``table``; rerunning a batch changes nothing."""
    def write(batch: DataFrame, _: int) -> None:
        upsert(batch, table)

    return records.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def upsert_bucketed_stream(records: DataFrame, table: str, checkpoint: str, key: str = "id"):
    """Start the stream into a bucketed table: a micro-batch rewrites the buckets that it touches, and one that was published before a
    restart is not applied again. The size of a batch is ``files_per_trigger`` of ``record_stream``."""

    def write(batch: DataFrame, number: int) -> None:
        BucketedTable(batch.sparkSession, table, key).upsert(batch, batch_id=f"{checkpoint}#{number}")

    return records.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """An extension: counts and sums by event type in tumbling windows, with a watermark for late rows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
