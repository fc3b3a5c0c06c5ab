"""Additions of our own: day sums over a stream, and a stream's first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """Rows by day and kind; days close `late` after they end. The same plan serves a table and a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day"), kind).agg(F.count("*").alias("n")).select(F.to_date("day.start").alias("day"), kind, "n")


def first_seen(stream: DataFrame, ts: str, text: str, late: str = "1 day") -> DataFrame:
    """DD1 on a stream: exact copies within the watermark go."""
    return stream.withColumn("_key", F.md5(text)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
