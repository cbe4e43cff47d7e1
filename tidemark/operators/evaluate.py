"""Scores of discovery and clustering against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f_score of two sets of rows."""
    a, b = found.select(*keys).distinct().withColumn("f", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = a.join(b, keys, "full_outer")
    f, t = F.col("f").isNotNull(), F.col("t").isNotNull()
    counts = both.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"))
    ratio = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    scored = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return scored.withColumn("f_score", ratio(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def missed(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the truth that were not found."""
    return truth.join(found.select(*keys).distinct(), keys, "left_anti")


def partition_scores(parts: DataFrame) -> DataFrame:
    """ari, homogeneity, completeness, v_measure, fowlkes_mallows of two clusterings (node, a, b), from their contingency table."""
    cells = parts.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("n")), cells.groupBy("b").agg(F.sum("n").alias("n"))
    entropy = lambda n: F.sum(n * F.ln(n))
    sums = cells.agg(F.sum(pairs(F.col("n"))).alias("ij"), entropy(F.col("n")).alias("e_ij"), F.sum("n").alias("total"))
    sums = sums.crossJoin(rows.agg(F.sum(pairs(F.col("n"))).alias("i"), entropy(F.col("n")).alias("e_i"))).crossJoin(cols.agg(F.sum(pairs(F.col("n"))).alias("j"), entropy(F.col("n")).alias("e_j")))
    n = F.col("total")
    expected = F.col("i") * F.col("j") / F.nullif(pairs(n), F.lit(0.0))
    ari = F.coalesce((F.col("ij") - expected) / F.nullif((F.col("i") + F.col("j")) / 2 - expected, F.lit(0.0)), F.lit(1.0))
    mutual = (F.col("e_ij") - F.col("e_i") - F.col("e_j")) / n + F.ln(n)
    h_a, h_b = F.ln(n) - F.col("e_i") / n, F.ln(n) - F.col("e_j") / n
    part = lambda h: F.when(h < 1e-12, 1.0).otherwise(mutual / F.nullif(h, F.lit(0.0)))
    out = sums.select(ari.alias("ari"), part(h_a).alias("homogeneity"), part(h_b).alias("completeness"), F.coalesce(F.col("ij") / F.nullif(F.sqrt(F.col("i") * F.col("j")), F.lit(0.0)), F.lit(0.0)).alias("fowlkes_mallows"))
    return out.withColumn("v_measure", F.coalesce(2 * F.col("homogeneity") * F.col("completeness") / F.nullif(F.col("homogeneity") + F.col("completeness"), F.lit(0.0)), F.lit(0.0)))


def edge_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """skeleton precision, recall and f_score of directed edges (src, dst, weight), the share of shared ones with the right direction, and their mean difference in weight."""
    plain = lambda e: e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), (F.col("src") < F.col("dst")).alias("up"), "weight")
    a, b = plain(found), plain(truth)
    shared = a.alias("a").join(b.alias("b"), ["u", "v"])
    direction = shared.agg(F.avg((F.col("a.up") == F.col("b.up")).cast("double")).alias("direction_ratio"), F.avg(F.abs(F.col("a.weight") - F.col("b.weight"))).alias("weight_difference"))
    return precision_recall(a, b, ["u", "v"]).crossJoin(direction)
