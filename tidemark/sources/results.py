"""Correlation results: their 28 columns, and files of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of result files, in their order.
_SIDE = ("domain", "table_id", "table_name", "agg_table", "agg_attr", "description", "agg_attr{}_missing_ratio", "agg_attr{}_zero_ratio", "original_attr{}_missing_ratio", "original_attr{}_zero_ratio", "cv")
RESULT_COLUMNS = (
    *(c.format(1) if "{}" in c else f"{c}1" for c in _SIDE), *(c.format(2) if "{}" in c else f"{c}2" for c in _SIDE),
    "correlation coefficient", "correlation coefficient after imputing avg", "correlation coefficient after imputing zero", "p value", "number of samples", "spatio-temporal key type",
)


def to_results(corrs: DataFrame, stats: DataFrame, profiles: DataFrame, names: dict[str, str] | None = None, drop_count: bool = False, values: DataFrame | None = None, domains: dict[str, str] | None = None, descriptions: dict[str, str] | None = None) -> DataFrame:
    """The 28 columns from correlations (kind, agg1, tbl1, var1, ..., n, r, p), column_stats and column_profile.

    A variable's variation coefficient is taken of its aggregated table; ratios of a count are null. Statistics have
    one row a variable and are joined, not collected. ``names`` and ``domains`` give tables' titles and fields,
    ``descriptions`` texts of ``table.column``, and ``values`` (value_profile) the ratios of aggregated variables.
    """
    as_map = lambda d: F.create_map(*(F.lit(x) for kv in (d or {"": ""}).items() for x in kv))
    table, field, text = map(as_map, (names, domains, descriptions))
    out = corrs.filter("var1 <> 'count' AND var2 <> 'count'") if drop_count else corrs
    spread = F.sqrt(F.col("res_sum") / F.nullif(F.col("cnt") - 1, F.lit(0)))
    for i in "12":
        s = stats.select(F.col("agg").alias(f"agg{i}"), F.col("var").alias(f"var{i}"), F.try_divide(spread, F.abs("avg")).alias(f"cv{i}"))
        p = profiles.select(F.col("tbl").alias(f"tbl{i}"), F.concat(F.lit("avg_"), "var").alias(f"var{i}"), F.col("missing_ratio").alias(f"miss{i}"), F.col("zero_ratio").alias(f"zero{i}"))
        out = out.join(s, [f"agg{i}", f"var{i}"], "left").join(p, [f"tbl{i}", f"var{i}"], "left")
        if values is not None:
            v = values.select(F.col("agg").alias(f"agg{i}"), F.col("var").alias(f"var{i}"), F.col("missing_ratio").alias(f"vmiss{i}"), F.col("zero_ratio").alias(f"vzero{i}"))
            out = out.join(v, [f"agg{i}", f"var{i}"], "left")
    have = set(out.columns)
    null = F.lit(None).cast("double")

    def side(i: str) -> list:
        of_values = [F.col(f"v{c}{i}") if values is not None else null for c in ("miss", "zero")]
        told = F.coalesce(text[F.concat_ws(".", f"tbl{i}", F.regexp_replace(f"var{i}", "^avg_", ""))], F.lit(""))
        cells = [F.coalesce(field[F.col(f"tbl{i}")], F.lit("")), F.col(f"tbl{i}"), F.coalesce(F.get(F.array(table[F.col(f"tbl{i}")]), F.lit(0)), F.col(f"tbl{i}")), F.col(f"agg{i}"), F.col(f"var{i}"), told, *of_values, F.col(f"miss{i}"), F.col(f"zero{i}"), F.col(f"cv{i}")]
        return [v.alias(c.format(i) if "{}" in c else f"{c}{i}") for v, c in zip(cells, _SIDE)]

    pick = lambda c: F.col(c) if c in have else null
    tail = [F.bround("r", 3), F.bround(pick("r_impute_avg"), 3), F.bround(pick("r_impute_zero"), 3), F.bround("p", 3), F.col("n"), F.col("kind")]
    return out.select(*side("1"), *side("2"), *(v.alias(c) for v, c in zip(tail, RESULT_COLUMNS[22:])))


def write_results(results: DataFrame, path: str, form: str = "csv") -> None:
    """One folder a starting table."""
    results.withColumn("start", F.col("agg_table1")).write.mode("overwrite").partitionBy("start").format(form).option("header", True).save(path)


def read_results(spark: SparkSession, path: str, drop_count: bool = True, keep_count_of: tuple[str, ...] = ()) -> DataFrame:
    """All results under a folder; variables that are counts are left out but for the tables named."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    if not drop_count:
        return rows
    for i in "12":
        rows = rows.filter((F.col(f"agg_attr{i}") != "count") | F.col(f"table_id{i}").isin(*keep_count_of, ""))
    return rows


def drop_words(results: DataFrame, words: list[str]) -> DataFrame:
    """Without the variables ``avg_<word>``."""
    bad = [f"avg_{w}" for w in words]
    return results.filter(~F.col("agg_attr1").isin(bad) & ~F.col("agg_attr2").isin(bad)) if bad else results


def correlation_map(results: DataFrame, by: str = "name", perfect: bool = True) -> DataFrame:
    """one, two, r: each pair of variables once, as ``table--attribute`` in order, with its coefficient.

    ``by`` names tables by their title (name) or their id; attributes lose the ending that tells the sides apart. Without
    ``perfect`` coefficients of 1 and -1 are left out; of several correlations of a pair the largest |r| stays.
    """
    column = {"name": "table_name", "id": "table_id"}[by]
    node = lambda i: F.concat_ws("--", f"{column}{i}", F.regexp_replace(f"agg_attr{i}", f"_t{i}$", ""))
    r = F.col("correlation coefficient").cast("double")
    rows = results.select(F.array_sort(F.array(node(1), node(2))).alias("n"), r.alias("r")).filter("r IS NOT NULL")
    if not perfect:
        rows = rows.filter(F.abs("r") < 1)
    return rows.groupBy(F.get("n", F.lit(0)).alias("one"), F.get("n", F.lit(1)).alias("two")).agg(F.max_by("r", F.abs("r")).alias("r"))
