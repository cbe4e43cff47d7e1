"""Aggregated tables kept up to date from a stream. Beyond what the batch engine needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rollup(events: DataFrame, ts: str = "ts", value: str = "value", group: str = "event_type", size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """group, bin_start, n, avg_value of a stream of events; rows later than ``late`` are left out."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    bins = timed.groupBy(F.window("_t", size).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"avg_{value}"))
    return bins.select(group, F.col("w.start").alias("bin_start"), "n", f"avg_{value}")


def start(bins: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a rollup over what is there now; each batch writes the bins that it changed to a folder of its own.

    A batch that is run again after a failure replaces its folder, so no bin is counted twice. ``current`` reads the result.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bins.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, group: str = "event_type") -> DataFrame:
    """Every bin as the last batch that changed it left it."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (group, "bin_start", "batch")]
    last = rows.groupBy(group, "bin_start").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(group, "bin_start", "v.*")
