"""Running totals and positions within groups of any size, without gathering a group in one task.

Rows are dealt to tasks by ranges of (group, order); each range is summed by itself, and the totals of the ranges before
it in its group, a short table, are added.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder, a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(frame: DataFrame, name: str = "rows") -> DataFrame:
    """The frame written to the shared folder and read again: its lineage is cut, and a lost executor costs a reread."""
    path = f"{shared_root(frame.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def running_totals(rows: DataFrame, group: list[str], order: list[str], weight: str, name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over the rows that stand before each one in its group.

    The combination of group and order must be unique, so sum equal rows up first. A range of a group is a task's
    share; a group of any size spreads over as many tasks as it fills.
    """
    cut = stored(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_inside", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    # One row for each group and range: as many as there are groups and ranges together, not rows.
    totals = cut.groupBy(*group, "_part").agg(F.sum(weight).alias("_total"))
    upto = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_offset"))
    return inside.join(offsets, [*group, "_part"]).withColumn(name, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")


def average_ranks(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the average rank (from 1) of ``value`` in its group, and in ``name``_ties how many rows share it.

    Equal values are counted before they are dealt out, so a value that fills a group is one row of the ranking.
    """
    counted = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias(f"{name}_ties"))
    ranked = running_totals(counted, group, [value], f"{name}_ties", "_before")
    ranks = ranked.select(*group, value, f"{name}_ties", (F.col("_before") + (F.col(f"{name}_ties") + 1) / 2).alias(name))
    return rows.join(ranks, [*group, value])


def dense_places(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the place (from 0) of ``value`` among the distinct values of its group."""
    distinct = rows.select(*group, value).distinct().withColumn("_one", F.lit(1).cast("long"))
    return rows.join(running_totals(distinct, group, [value], "_one", name).drop("_one"), [*group, value])


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each share: exact quantiles of the known values, interpolated between neighbours.

    Values are counted first and their places come from ranges; of a group only the few values around its quantiles
    meet. A group without a value has no row.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    placed = stored(running_totals(counted, group, ["_x"], "_k", "_before"), "placed")
    sizes = placed.groupBy(*group).agg(F.sum("_k").alias("_n"))  # a row a group
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * share).alias("at")) for name, share in shares.items()))
    spots = placed.join(sizes, group).withColumn("_w", F.explode(wanted)).select(*group, "_x", "_k", "_before", "_w.name", "_w.at")
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_k"))
    met = spots.filter(holds(F.floor("at")) | holds(F.ceil("at")))
    low, high = F.max(F.when(holds(F.floor("at")), F.col("_x"))), F.max(F.when(holds(F.ceil("at")), F.col("_x")))
    each = met.groupBy(*group, "name", "at").agg(low.alias("low"), high.alias("high"))
    one = each.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")))
    return one.groupBy(*group).agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in shares))
