"""Counts and sums of events in bins of time, ends left open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """bin_start, n, total for bins of one size side by side."""
    return _grouped(events, F.window(ts, size), value)


def sliding(events: DataFrame, size: str, step: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """bin_start, n, total for bins that start every ``step``."""
    return _grouped(events, F.window(ts, size, step), value)


def centred(events: DataFrame, radius_seconds: int, step: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """bin_start, n, total within a radius of points ``step`` apart; ``bin_start`` is the point."""
    bins = _grouped(events, F.window(ts, f"{2 * radius_seconds} seconds", step), value)
    return bins.withColumn("bin_start", F.col("bin_start") + F.make_interval(secs=F.lit(radius_seconds)))


def occupied(bins: DataFrame) -> DataFrame:
    """Bins as 0 or 1."""
    return bins.withColumn("n", (F.col("n") > 0).cast("long"))


def _grouped(events: DataFrame, window, value: str) -> DataFrame:
    return events.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("bin_start"), "n", "total")
