"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_ids(rows: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id and ``label`` of up to ``most`` ids of every class, those with the smallest hashes of their ids.

    Each class's distinct ids are estimated first (to some 5 %), so that all but about four times ``most`` ids of each
    are left out where they are read, and only those are ranked: a class that fills the table is not gathered in one
    task, and one whose rows repeat a few ids keeps them.
    """
    keys = rows.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    counts = keys.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("n"))
    hashed = keys.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    share = (F.col("h").cast("double") / F.lit(2.0**63) + 1) / 2
    few = hashed.join(F.broadcast(counts), label).filter(share * F.col("n") <= 4 * most).select("doc_id", label, "h").distinct()
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy("h", "doc_id")))
    return ranked.filter(F.col("r") <= most).select("doc_id", label)
