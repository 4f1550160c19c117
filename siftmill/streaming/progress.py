"""An extension: the status queue of a long build as a stream of events, counted by window as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and key; the watermark bounds the state. Works on streams and tables alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def follow(spark: SparkSession, source: str, schema, checkpoint: str, target: str, time: str, key: str):
    """Appends closed windows of a folder of Parquet files to another folder; resumes from its checkpoint."""
    rows = spark.readStream.schema(schema).parquet(source)
    return windowed_counts(rows, time, key).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
