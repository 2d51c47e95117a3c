"""An extension beyond the reference, which has no streams: a directory of text files as a stream,
whose facts are stateless, so findings need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, root: str, pattern: str = "*.rs", per_trigger: int = 1000) -> DataFrame:
    """(path, content) of files as they arrive."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(root)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window, with a watermark for what comes late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
