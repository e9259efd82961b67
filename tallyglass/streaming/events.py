"""Streaming ingest of events into panel bars: late rows within the watermark change a bar, later ones do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive, by the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_bars(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """asset, date, volume, low, high and sum of values, by event day."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    daily = timed.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("asset"))
    bars = daily.agg(F.count("*").alias("volume"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
    return bars.select("asset", F.to_date("window.start").alias("date"), "volume", "low", "high", "total")


def write_bars(bars: DataFrame, path: str, checkpoint: str):
    """Append finished bars to a table; the checkpoint makes each bar appear once."""
    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start()
