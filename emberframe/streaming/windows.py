"""The same metrics on streams: event-time windows with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_metric(stream: DataFrame, metric: Callable[[Column, Column], Column], x: str, ref: str, *group: str, time: str = "ts", size: str = "6 hours", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """A metric of ``operators.metrics`` per window and group: window_start, window_end, the group, kpi, n.

    Works on batches and streams; times without a zone are read in the session's. Rows later than ``late`` are
    left out by the watermark.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    span = F.window(time, size, slide) if slide else F.window(time, size)
    out = timed.groupBy(span.alias("w"), *group).agg(metric(F.col(x), F.col(ref)).alias("kpi"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *group, "kpi", "n")


def run_available(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, writes it as Parquet, and reads it back."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
