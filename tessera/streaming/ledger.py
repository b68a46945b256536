"""Event logs as streams: running ledgers and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """An append-only folder of Parquet event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ledger(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Sightings, first and last time and total value of each key; the same plan for a batch and a stream."""
    return events.groupBy(key).agg(F.count("*").alias("sightings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("value").alias("total"))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; events later than late are dropped by a stream."""
    when = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(when.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Sessions of each key with a gap between events of at most gap."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is available and stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
    query.awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The result of a stream over all that is available, from memory; for small results and tests."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
