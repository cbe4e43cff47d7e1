"""Statistics as column expressions, safe for constant and empty inputs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Steps of the continued fractions and series below; with the ranges they are used in, more change nothing in a double.
STEPS = 64


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation of rows where both are known; 0 if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.coalesce(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)), F.lit(0.0))


def _fraction(start: np.ndarray, c: np.ndarray, m_terms) -> np.ndarray:
    """Value of a continued fraction by Lentz's method: ``m_terms(m)`` are the partial numerators of step m, with their denominators."""
    d = h = start
    for m in range(1, STEPS + 1):
        for above, below in m_terms(m):
            d = 1 / (below + above * d)
            c = below + above / c
            h = h * c * d
    return h


def _log_gamma_ratio(a: np.ndarray) -> np.ndarray:
    """log(Gamma(a + 1/2) / Gamma(a)) for a > 0: a is moved up by 16, where an asymptotic series is exact in a double.

    The ratio itself is expanded, so that nothing cancels for large a, as it would between two logarithms.
    """
    up = sum(np.log1p(-0.5 / (a + j + 0.5)) for j in range(16))
    z = a + 16
    return up + 0.5 * np.log(z) - 1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7)


@F.arrow_udf(DoubleType())
def _log_beta_tail(half: pa.Array, size: pa.Array) -> pa.Array:
    """Logarithm of the regularised incomplete beta function of 1 - size^2 at (half, 1/2), a batch of rows at a time."""
    with np.errstate(all="ignore"):  # rows without freedom or with a size of 0 or 1 are told apart by the caller
        a, r = (np.asarray(x.cast(pa.float64()).to_numpy(zero_copy_only=False)) for x in (half, size))
        square = r * r
        tail = 1 - square < (a + 1) / (a + 2.5)
        p, q, x = np.where(tail, a, 0.5), np.where(tail, 0.5, a), np.where(tail, 1 - square, square)

        def terms(m: int) -> list[tuple[np.ndarray, float]]:
            one = m * (q - m) * x / ((p - 1 + 2 * m) * (p + 2 * m))
            two = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 1 + 2 * m))
            return [(one, 1.0), (two, 1.0)]

        value = _fraction(1 / (1 - (p + q) * x / (p + 1)), np.ones_like(p), terms)
        whole = a * np.log1p(-square) + np.log(r) + _log_gamma_ratio(a) - 0.5 * math.log(math.pi) - np.log(p) + np.log(value)
        return pa.array(np.where(tail, whole, np.log1p(-np.exp(whole))))


def correlation_log_p(r: Column, n: Column, controls: int = 0) -> Column:
    """Natural logarithm of the two-sided p-value of a correlation of n samples with ``controls`` variables held fixed; null without freedom.

    With v degrees of freedom p is the regularised incomplete beta function of 1 - r^2 at (v / 2, 1 / 2). It is taken
    by its continued fraction in logarithms, at whichever end the fraction converges, so tails far below the
    smallest double keep their order. -infinity for |r| = 1. Batches of rows go through the fraction together; as an
    expression of Spark it is interpreted, and takes milliseconds a row.
    """
    v = (n - 2 - controls).cast("double")
    size = F.abs(r).cast("double")
    out = _log_beta_tail(v / 2, size)
    nothing = F.lit(None).cast("double")
    return F.when(v < 1, nothing).when(size >= 1, F.lit(float("-inf"))).when(size == 0, 0.0).otherwise(F.least(out, F.lit(0.0)))


def correlation_p(r: Column, n: Column, controls: int = 0) -> Column:
    """Two-sided p-value; below the smallest double it is 0, where ``correlation_log_p`` still tells."""
    return F.exp(correlation_log_p(r, n, controls))


@F.arrow_udf(DoubleType())
def _normal_tail(z: pa.Array) -> pa.Array:
    with np.errstate(all="ignore"):
        z = np.asarray(z.to_numpy(zero_copy_only=False))
        x = z * z / 2
        term = total = np.full_like(x, 2.0)
        for m in range(1, STEPS + 1):
            term = term * x / (m + 0.5)
            total = total + term
        fraction = _fraction(1 / (x + 0.5), np.full_like(x, 1e300), lambda m: [(-m * (m - 0.5), x + 0.5 + 2 * m)])
        scale = np.exp(-x) * np.sqrt(x / math.pi)
        return pa.array(np.where(x < 3, np.maximum(1 - scale * total, 0.0), scale * fraction))


def two_sided_normal(z: Column) -> Column:
    """P(|Z| >= z): a series of the incomplete gamma function of z^2 / 2 for small z, its continued fraction beyond; null for a null."""
    z = z.cast("double")
    return F.when(z.isNotNull(), _normal_tail(z))


def packed_correlations(columns: list[Column]) -> Column:
    """Aggregate: the correlations of every two columns as an array of len(columns)^2, row by row; 0 with a constant, 1 with itself."""
    k = len(columns)
    spread = [F.stddev_pop(c) for c in columns]
    r = {(i, j): F.coalesce(F.covar_pop(columns[i], columns[j]) / F.nullif(spread[i] * spread[j], F.lit(0.0)), F.lit(0.0)) for i in range(k) for j in range(i)}
    return F.array(*(F.lit(1.0) if i == j else r[max(i, j), min(i, j)] for i in range(k) for j in range(k)))


def held_fixed(r: Column, k: int, controls: range) -> Column:
    """A packed matrix of correlations of k variables after those at the places ``controls`` are held fixed, one after the other.

    Each elimination touches every entry once, so the work is k^2 a control. A control that those before it explain
    changes nothing; entries of a variable that the controls explain are null.
    """

    def eliminate(m: Column, c: Column) -> Column:
        at = lambda i, j: F.coalesce(F.get(m, i * k + j), F.lit(0.0))

        def entry(q: Column) -> Column:
            i, j = F.floor(q / k).cast("int"), (q % k).cast("int")
            left = lambda b: F.nullif(F.when(1 - b * b > 1e-12, 1 - b * b).otherwise(0.0), F.lit(0.0))
            fixed = (F.get(m, q) - at(i, c) * at(j, c)) / F.sqrt(left(at(i, c)) * left(at(j, c)))
            return F.when((i == c) | (j == c), F.get(m, q)).otherwise(fixed)

        return F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), entry)

    return F.aggregate(F.array(*map(F.lit, controls)), r, eliminate) if len(controls) else r


def imputed_mean(xy: Column, sx: Column, sy: Column, n: Column, mean_x: Column, mean_y: Column, res_x: Column, res_y: Column) -> Column:
    """Correlation after missing keys are filled with each column's mean: only sums over the shared keys are needed."""
    cross = xy - mean_y * sx - mean_x * sy + n * mean_x * mean_y
    return cross / F.nullif(F.sqrt(res_x * res_y), F.lit(0.0))


def imputed_zero(xy: Column, sum_x: Column, sum_y: Column, square_x: Column, square_y: Column, n: Column) -> Column:
    """Correlation after missing keys are filled with zero; n counts the keys of either table."""
    spread = F.sqrt(F.greatest(n * square_x - sum_x * sum_x, F.lit(0.0))) * F.sqrt(F.greatest(n * square_y - sum_y * sum_y, F.lit(0.0)))
    return (n * xy - sum_x * sum_y) / F.nullif(spread, F.lit(0.0))
