"""Joins of aggregated tables on their key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(df: DataFrame, names: list[str], suffix: str) -> DataFrame:
    return df.select("val", *(F.col(n).alias(f"{n}_{suffix}"[:63]) for n in names))


def align_inner(a: DataFrame, vars_a: list[str], b: DataFrame, vars_b: list[str]) -> DataFrame:
    """``val`` and the variables of both tables, suffixed ``t1`` and ``t2``, for the keys of both."""
    return _side(a, vars_a, "t1").join(_side(b, vars_b, "t2"), "val")


def align_outer(a: DataFrame, vars_a: list[str], b: DataFrame, vars_b: list[str]) -> DataFrame:
    """``key1``, ``key2`` and the variables of both tables for the keys of either."""
    left, right = _side(a, vars_a, "t1").withColumnRenamed("val", "key1"), _side(b, vars_b, "t2").withColumnRenamed("val", "key2")
    return left.join(right, left["key1"] == right["key2"], "full_outer")


def join_and_project(tables: dict[str, DataFrame], variables: list[tuple[str, str]], constraints: dict[str, int] | None = None, samples: bool = False) -> DataFrame:
    """``val`` and (table, variable) pairs of any number of tables on their common keys.

    ``constraints`` gives the least ``count`` of a table's rows behind a key; ``samples`` adds those counts. Counts are
    tested before the join.
    """
    used = list(dict.fromkeys(t for t, _ in variables))
    sides = []
    for t in used:
        rows = tables[t]
        if constraints and t in constraints:
            rows = rows.filter(F.col("count") >= constraints[t])
        own = [F.col(v).alias(f"{t}_{v}"[:63]) for name, v in variables if name == t]
        sides.append(rows.select("val", *own, *([F.col("count").alias(f"{t}_samples")] if samples else [])))
    return reduce(lambda x, y: x.join(y, "val"), sides)


def align_reduced(a: DataFrame, key_a: Column, b: DataFrame, key_b: Column, measure_a: str, measure_b: str) -> DataFrame:
    """Raw tables joined on their key after rows without a partner are dropped and the rest is aggregated."""
    left, right = a.withColumn("val", key_a), b.withColumn("val", key_b)
    left_kept, right_kept = left.join(right.select("val").distinct(), "val", "left_semi"), right.join(left.select("val").distinct(), "val", "left_semi")
    return left_kept.groupBy("val").agg(F.avg(measure_a).alias("a")).join(right_kept.groupBy("val").agg(F.avg(measure_b).alias("b")), "val")


def shared_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of both tables."""
    return a.select("val").intersect(b.select("val"))


def joined_row(tables: dict[str, DataFrame], row) -> DataFrame:
    """The joined data behind one correlation (agg_table1, agg_attr1, agg_table2, agg_attr2)."""
    named = lambda a: a if a == "count" or a.startswith("avg_") else f"avg_{a}"
    return align_inner(tables[row["agg_table1"]], [named(row["agg_attr1"])], tables[row["agg_table2"]], [named(row["agg_attr2"])])
