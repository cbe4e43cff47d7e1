"""Correlation searches as one plan: keys, joinable pairs, moments, p-values, correction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import correlate, index, measures
from tidemark.operators.counters import Counters


@dataclass(frozen=True)
class Options:
    overlap: int = 5
    r_least: float = 0.6
    p_most: float = 0.05
    coefficient: str = "pearson"  # or spearman, kendall
    method: str = "INDEX_SEARCH"  # or PREFIX_SEARCH, JOIN_ALL, COST_MODEL
    correction: str = ""  # or FDR
    q: float = 0.05
    impute: bool = False


def search_pairs(keys: DataFrame, options: Options, watch: Counters | None = None) -> DataFrame:
    """kind, agg1, agg2 by the method that the options name.

    ``COST_MODEL`` rates an index search and a join of all for every table and takes the one that most tables are
    cheaper with; the pairs that fall short of the overlap are dropped later in either case.
    """
    method = options.method
    if method == "COST_MODEL":
        rated = index.choose_method(keys, options.overlap).groupBy("method").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "method").first()
        method = rated["method"] if rated else "INDEX_SEARCH"
    if method == "JOIN_ALL":
        return index.all_pairs(keys, options.overlap)
    search = {"INDEX_SEARCH": index.joinable_pairs, "PREFIX_SEARCH": index.pairs_at_least}[method]
    return search(keys, options.overlap, watch).select("kind", "agg1", "agg2")


def correlations(long: DataFrame, options: Options, start: str | None = None, watch: Counters | None = None) -> DataFrame:
    """Correlations between variables of joinable tables, each pair of tables once, starting from the one with fewer keys.

    ``start`` keeps the pairs of one raw table, which then stands first. Pairs are tested for overlap before any
    measure is joined. Without correction |r| and p prune; with ``FDR`` the procedure and |r| do. ``watch`` counts keys
    met, pairs of tables, correlations tested and those kept.
    """
    mark = watch.on if watch else lambda df, name: df
    keys = measures.keys_of(long)
    found = mark(search_pairs(keys, options, watch), "pairs")
    if start is not None:
        own = keys.select(F.col("agg").alias("own"), (F.col("tbl") == start).alias("mine")).distinct()
        tagged = found.join(own.withColumnRenamed("own", "agg1").withColumnRenamed("mine", "m1"), "agg1").join(own.withColumnRenamed("own", "agg2").withColumnRenamed("mine", "m2"), "agg2")
        found = tagged.filter("m1 OR m2").select("kind", F.when(F.col("m1"), F.col("agg1")).otherwise(F.col("agg2")).alias("agg1"), F.when(F.col("m1"), F.col("agg2")).otherwise(F.col("agg1")).alias("agg2"))
    if options.coefficient == "pearson":
        stats = measures.column_stats(long)
        out = correlate.pearson_pairs(long, found, stats if options.impute else None)
        if not options.impute:
            usable = stats.filter(F.col("avg").isNotNull() & (F.col("res_sum") != 0)).select("agg", "var")
            for i in "12":
                out = out.join(usable.select(F.col("agg").alias(f"agg{i}"), F.col("var").alias(f"var{i}")), [f"agg{i}", f"var{i}"], "left_semi")
    else:
        joined = correlate.joined_pairs(long, found)
        tables = joined.select("agg1", "tbl1", "agg2", "tbl2").distinct()
        out = correlate.COEFFICIENTS[options.coefficient](joined).join(tables, ["agg1", "agg2"])
    out = mark(out.filter(F.col("n") >= options.overlap), "tested")
    if options.correction == "FDR":
        return mark(correlate.benjamini_hochberg(out, options.q, options.r_least), "kept")
    return mark(out.filter((F.abs("r") >= options.r_least) & (F.col("p") <= options.p_most)), "kept")

