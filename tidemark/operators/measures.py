"""Aligning tables: one aggregated table per key, and the long form that holds all of them.

The long form has a row for every aggregated table, variable and key value: ``kind`` (temporal, spatial, st), ``agg``,
``tbl``, ``var``, ``val``, ``x``. A null ``x`` is a key whose rows all lack the variable; it is kept, as it stands for 0
in a joined frame. Everything downstream joins and groups this one table, so that all pairs are a single job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The aggregates that a variable may ask for.
AGGREGATES = {"avg": F.avg, "min": F.min, "max": F.max, "median": F.median, "sum": F.sum, "count": F.count}


@dataclass(frozen=True)
class Variable:
    """A measure of a table under an aggregate; its name in results has at most 63 characters."""

    column: str
    aggregate: str = "avg"

    @property
    def name(self) -> str:
        return "count" if self.column == "*" else f"{self.aggregate}_{self.column}"

    def shown(self, suffix: str) -> str:
        return f"{self.name}_{suffix}"[:63]


@dataclass
class Source:
    """A raw table with its keys: named columns of time and place, and the measures to aggregate."""

    tbl: str
    df: DataFrame
    times: dict[str, Column] = field(default_factory=dict)  # name of the key -> key text
    places: dict[str, Column] = field(default_factory=dict)
    measures: tuple[str, ...] = ()

    def keys(self, cross: bool = True) -> list[tuple[str, str, Column]]:
        """kind, name of the aggregated table, key. Without ``cross`` the n-th time only meets the n-th place."""
        from tidemark.functions.keys import joint_key

        out = [("temporal", f"{self.tbl}_{n}", k) for n, k in self.times.items()] + [("spatial", f"{self.tbl}_{n}", k) for n, k in self.places.items()]
        pairs = [(t, s) for t in self.times.items() for s in self.places.items()] if cross else list(zip(self.times.items(), self.places.items()))
        return out + [("st", f"{self.tbl}_{t}_{s}", joint_key(tk, sk)) for (t, tk), (s, sk) in pairs]


def aggregate_by(df: DataFrame, key: Column, variables: list[Variable], with_count: bool = True) -> DataFrame:
    """``val``, one column a variable, and ``count``: rows without a key are left out before they are grouped."""
    keyed = df.withColumn("val", key.cast("string")).filter(F.col("val").isNotNull())
    columns = [AGGREGATES[v.aggregate](v.column).alias(v.name) for v in variables]
    return keyed.groupBy("val").agg(*columns, *([F.count(F.lit(1)).alias("count")] if with_count else []))


def aggregate_all(source: Source, cross: bool = True) -> DataFrame:
    """Every key of a source in one pass over its rows: kind, agg, val, ``avg_*`` and count."""
    keys = source.keys(cross)
    tagged = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(agg).alias("agg"), key.cast("string").alias("val")) for kind, agg, key in keys))
    rows = source.df.select(F.explode(tagged).alias("k"), *source.measures).select("k.*", *source.measures).filter("val IS NOT NULL")
    return rows.groupBy("kind", "agg", "val").agg(*(F.avg(m).alias(f"avg_{m}") for m in source.measures), F.count(F.lit(1)).alias("count"))


def long_form(wide: DataFrame, tbl: str, round_dp: int | None = None) -> DataFrame:
    """Unpivot aggregated tables (kind, agg, val, variables). ``round_dp`` rounds half to even."""
    names = [c for c in wide.columns if c not in ("kind", "agg", "val")]
    flat = wide.select("kind", "agg", "val", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["kind", "agg", "val"], names, "var", "x")
    x = F.bround("x", round_dp) if round_dp is not None else F.col("x")
    return flat.select("kind", "agg", F.lit(tbl).alias("tbl"), "var", "val", x.alias("x"))


def measures(sources: list[Source], cross: bool = True, round_dp: int | None = 3) -> DataFrame:
    """The long form of all sources."""
    return reduce(DataFrame.unionByName, (long_form(aggregate_all(s, cross), s.tbl, round_dp) for s in sources))


def keys_of(long: DataFrame) -> DataFrame:
    """kind, agg, tbl, val: each aggregated table's keys, read from its count column."""
    return long.filter(F.col("var") == "count").select("kind", "agg", "tbl", "val")


def column_stats(long: DataFrame, known_only: bool = False, by: tuple[str, ...] = ("agg", "var")) -> DataFrame:
    """agg, var (or ``by``), sum, sum_square, avg, res_sum, cnt. ``cnt`` and ``res_sum`` count keys with a null x too, unless ``known_only``."""
    rows = F.count("x") if known_only else F.count(F.lit(1))
    spread = F.coalesce(F.var_samp("x"), F.lit(None).cast("double"))
    return long.groupBy(*by).agg(
        F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sum_square"), F.avg("x").alias("avg"), ((rows - 1) * spread).alias("res_sum"), rows.alias("cnt")
    )


def column_profile(df: DataFrame, tbl: str, columns: tuple[str, ...]) -> DataFrame:
    """tbl, var, missing_ratio, zero_ratio of raw columns, of all rows, to two places; null for a table without rows."""
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    ratios = df.agg(*(F.struct(F.round(F.count_if(F.col(c).isNull()) / n, 2).alias("missing_ratio"), F.round(F.count_if(F.col(c) == 0) / n, 2).alias("zero_ratio")).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(tbl).alias("tbl"), F.lit(c).alias("var"), F.col(c)["missing_ratio"].alias("missing_ratio"), F.col(c)["zero_ratio"].alias("zero_ratio")) for c in columns))
    return ratios.select(F.inline(rows))


def varying(long: DataFrame) -> DataFrame:
    """agg, n_vars: variables of each aggregated table that take more than one value."""
    distinct = long.groupBy("agg", "var").agg((F.min("x") < F.max("x")).alias("varies"))
    return distinct.groupBy("agg").agg(F.count_if("varies").alias("n_vars"))


def rows_per_key(long: DataFrame) -> DataFrame:
    """agg, avg_rows, median_rows: how many raw rows stand behind a key of each aggregated table."""
    from tidemark.operators.ranges import quantiles

    counts = long.filter(F.col("var") == "count").select("agg", "x")
    return counts.groupBy("agg").agg(F.avg("x").alias("avg_rows")).join(quantiles(counts, ["agg"], "x", {"median_rows": 0.5}), "agg", "left")


def value_profile(long: DataFrame, by: tuple[str, ...] = ("agg", "var")) -> DataFrame:
    """agg, var, missing_ratio, zero_ratio of each aggregated variable's values, to two places."""
    n = F.count(F.lit(1))
    return long.groupBy(*by).agg(F.round(F.count_if(F.col("x").isNull()) / n, 2).alias("missing_ratio"), F.round(F.count_if(F.col("x") == 0) / n, 2).alias("zero_ratio"))
