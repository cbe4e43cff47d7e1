"""Tables with a known structure: variables in communities, each a noisy sum of its parents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def community_graph(communities: int = 3, size: int = 10, noise: int = 10, inside: float = 0.7, across: float = 0.02, seed: int = 0) -> tuple[list[int], dict[tuple[int, int], float]]:
    """Each variable's community (-1 for none) and the weights of the edges parent -> child, parents first."""
    rng = np.random.default_rng(seed)
    of = [c for c in range(communities) for _ in range(size)] + [-1] * noise
    edges = {}
    for child in range(len(of)):
        for parent in range(child):
            if of[parent] < 0 or of[child] < 0:
                continue
            if rng.random() < (inside if of[parent] == of[child] else across):
                edges[parent, child] = float(rng.uniform(0.5, 1.5) * rng.choice((-1, 1)))
    return of, edges


def sample(spark: SparkSession, n_variables: int, edges: dict[tuple[int, int], float], rows: int, kind: str = "linear", seed: int = 0) -> DataFrame:
    """``val`` and columns x0, x1, ... of a model: linear, binary (sign of the sum) or count (rounded exponential of it)."""
    df = spark.range(rows).select(F.col("id").cast("string").alias("val"), *(F.randn(seed * 1000 + i).alias(f"x{i}") for i in range(n_variables)))
    for child in range(n_variables):
        parents = [(p, w) for (p, c), w in edges.items() if c == child]
        total: Column = F.col(f"x{child}")
        scale = max(1.0, float(np.sqrt(sum(w * w for _, w in parents))))
        for p, w in parents:
            total = total + F.col(f"x{p}") * (w / scale)
        if kind == "binary":
            total = (total > 0).cast("double")
        elif kind == "count":
            total = F.floor(F.exp(F.least(total, F.lit(10.0)))).cast("double")
        df = df.withColumn(f"x{child}", total)
    return df


def calibrate(find_seconds: list[float], rows_read: list[int], join_seconds: list[float], join_costs: list[float], least_rows: int = 100_000) -> float:
    """The weight of a key read in an index search against a key joined: the median over large tables of the ratio of their unit times."""
    ratios = [(f / r) / (j / c) for f, r, j, c in zip(find_seconds, rows_read, join_seconds, join_costs) if r >= least_rows and j > 0 and c > 0]
    return float(np.median(ratios)) if ratios else 0.0
