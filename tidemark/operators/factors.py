"""Factor analysis of a correlation matrix. The matrix is variables by variables, a few hundred each way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variables that the driver's matrix may have.
MOST_VARIABLES = 5000


def correlation_matrix(corrs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and matrix from correlations (tbl1, var1, tbl2, var2, r); 1 on the diagonal, 0 where none is known.

    More than ``MOST_VARIABLES`` are refused before anything is gathered; of several correlations of a pair the largest counts.
    """
    ends = corrs.select("tbl1", "var1").union(corrs.select("tbl2", "var2")).distinct()
    if ends.limit(MOST_VARIABLES + 1).count() > MOST_VARIABLES:
        raise ValueError(f"more than {MOST_VARIABLES} variables")
    rows = corrs.groupBy("tbl1", "var1", "tbl2", "var2").agg(F.max_by("r", F.abs("r")).alias("r")).collect()
    pairs = {(f"{r.tbl1}--{r.var1}", f"{r.tbl2}--{r.var2}"): r.r for r in rows}
    names = sorted({n for p in pairs for n in p})
    at = {n: i for i, n in enumerate(names)}
    out = np.eye(len(names))
    for (a, b), r in pairs.items():
        out[at[a], at[b]] = out[at[b], at[a]] = r if a != b else 1.0
    return names, out


def loadings(matrix: np.ndarray, n_factors: int = 3, rounds: int = 200) -> np.ndarray:
    """Unrotated principal-axis loadings, each factor's sum positive; communalities are iterated from the largest |r|."""
    n = len(matrix)
    shared = np.abs(matrix - np.eye(n)).max(1) if n > 1 else np.ones(n)
    out = np.zeros((n, n_factors))
    for _ in range(rounds):
        reduced = matrix.copy()
        np.fill_diagonal(reduced, shared)
        value, vector = np.linalg.eigh(reduced)
        top = np.argsort(value)[::-1][:n_factors]
        out = np.zeros((n, n_factors))
        out[:, : len(top)] = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
        fresh = np.clip((out**2).sum(1), 0, 1)
        if np.abs(fresh - shared).max() < 1e-6:
            break
        shared = fresh
    sign = np.where(out.sum(0) < 0, -1, 1)
    return out * sign


def factor_clusters(names: list[str], loaded: np.ndarray, threshold: float = 0.5) -> dict[str, dict[str, list[str]]]:
    """``Cluster i`` -> table -> variables that load at least ``threshold`` on factor i."""
    out = {}
    for i in range(loaded.shape[1]):
        tables: dict[str, list[str]] = {}
        for name, v in zip(names, loaded[:, i]):
            if v >= threshold:
                tbl, var = name.split("--", 1)
                tables.setdefault(tbl, []).append(var)
        out[f"Cluster {i}"] = tables
    return out
