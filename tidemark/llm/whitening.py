"""Whitening of embeddings: principal components by LOBPCG over distributed products with the covariance.

Rows stay in Spark. Each step of the iteration is one job in which every task centres its rows, multiplies them with an
orthonormal block of directions and back, and Spark sums the small products; the driver holds blocks of dimension by
directions, never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import Scratch

#: A component's residual |V v - e v|, as a share of the largest eigenvalue, that counts as converged, and that is accepted at most.
RESIDUAL, CERTIFIED = 2e-14, 1e-10
#: A direction whose variance is a smaller share of the largest is rounding noise.
LEAST_VARIANCE = 1e-13


@dataclass(frozen=True)
class Centre:
    """Count of the fit list and the exact sums of each dimension, as whole parts and remainders of their means."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """x less its mean: the whole part is taken off as integers, so nothing cancels."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n


@dataclass(frozen=True)
class Components:
    """Unit directions in columns, their variances, and residuals relative to the largest; ``total`` is the covariance's trace."""

    directions: np.ndarray
    variances: np.ndarray
    residuals: np.ndarray
    total: float


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = len(column)
    return np.asarray(column.flatten()).reshape(rows, -1)


def quantize(rows: DataFrame, id_col: str, vec_col: str, step: int = 64, offset: int = 1_000_000) -> DataFrame:
    """id and x, the vector as integers floor(step * c) + offset; rows whose vector is null, empty, or holds a null, NaN or infinity are left out."""
    v = F.col(vec_col).cast("array<double>")
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c * step).cast("long") + F.lit(offset).cast("long"))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(id_col).alias("id"), x.alias("x"))


def fit_list(x: DataFrame) -> DataFrame:
    """The rows of the commonest length (of equally common ones the longest): no covariance holds vectors of two lengths."""
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1)
    return x.join(F.broadcast(lengths.select("d")), F.size("x") == F.col("d"), "left_semi")


def centre(x: DataFrame) -> Centre | None:
    """Exact sums: each long is split in two halves, which no batch can overflow, and Spark adds decimals; None for no rows."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        n = 0
        for b in batches:
            if len(b):
                m = _matrix(b.column("x"))
                high, low = (m >> 32).sum(0), (m & 0xFFFFFFFF).sum(0)
                own = [(int(h) << 32) + int(w) for h, w in zip(high, low)]
                total = [a + c for a, c in zip(total, own)] if total else own
                n += len(b)
        if n:
            import decimal

            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([decimal.Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * len(total))], ["i", "s", "n"])

    parts = x.select("x").mapInArrow(sums, "i int, s decimal(38,0), n long")
    rows = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # a row a dimension
    return Centre.of(rows[0].n, [int(r.s) for r in rows]) if rows else None


def covariance_product(x: DataFrame, mean: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance of the rows times ``block`` (dimension by directions), and the covariance's trace, in one job."""
    d, m = block.shape

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros((d, m)), 0.0
        for b in batches:
            for at in range(0, len(b), 4096):
                z = mean.shifted(_matrix(b.column("x").slice(at, 4096)))
                total += z.T @ (z @ block)
                square += float((z * z).sum())
        values = np.append(total.ravel(), square)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

    parts = x.select("x").mapInArrow(multiply, "i long, v double")
    summed = parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # dimension by directions, whatever the rows
    out = np.zeros(d * m + 1)
    out[np.asarray(summed["i"])] = np.asarray(summed["v"])
    return out[:-1].reshape(d, m) / mean.n, float(out[-1]) / mean.n


def _extend(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``basis`` and what ``block`` adds to it, orthonormal; directions that it holds already add nothing."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    if not block.size:
        return basis
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-9][:, : basis.shape[0] - basis.shape[1]]
    u = u - basis @ (basis.T @ u)
    return np.hstack([basis, np.linalg.qr(u)[0]]) if u.size else basis


def lobpcg(x: DataFrame, mean: Centre, want: int = 32, most_steps: int = 300, seed: int = 0) -> Components:
    """The ``want`` directions of largest variance, with guard directions beside them that speed up the last ones.

    Each step multiplies an orthonormal basis of the iterate, its residuals and the previous directions with the
    covariance, and takes the best directions within that basis (Rayleigh-Ritz). It ends when all residuals are at
    rounding level, or no longer fall; residuals above ``CERTIFIED`` are an error.
    """
    d = len(mean.whole)
    width = min(d, want + max(8, want // 2))
    iterate = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    basis, previous, best, stalled = iterate, None, np.inf, 0
    for _ in range(most_steps):
        product, total = covariance_product(x, mean, basis)
        inner = basis.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:width]
        values, turn = values[order], turn[:, order]
        fresh, image = basis @ turn, product @ turn
        top = max(values[0], np.finfo(float).tiny)
        residual = image - fresh * values
        sizes = np.linalg.norm(residual, axis=0)[:want] / top
        previous = fresh - iterate @ (iterate.T @ fresh)
        iterate = fresh
        keep = values[:want] > LEAST_VARIANCE * top
        worst = float(sizes[keep].max(initial=0.0))
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if worst <= RESIDUAL or (worst <= CERTIFIED and stalled >= 3) or total <= 0:
            break
        basis = _extend(_extend(iterate, residual), previous)
    if total > 0 and worst > CERTIFIED:
        raise ArithmeticError(f"residual {worst} after {most_steps} steps")
    keep &= total > 0
    return Components(iterate[:, :want][:, keep], values[:want][keep], sizes[keep], total)


def _project(x: np.ndarray, mean: Centre, found: Components) -> np.ndarray:
    return mean.shifted(x) @ (found.directions / np.sqrt(found.variances))


def identity_error(x: DataFrame, mean: Centre, found: Components) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, from the rows themselves."""
    k = len(found.variances)

    def outer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            for at in range(0, len(b), 4096):
                w = _project(_matrix(b.column("x").slice(at, 4096)), mean, found)
                total[:k] += w.T @ w
                total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    summed = x.select("x").mapInArrow(outer, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((k + 1) * k)
    out[np.asarray(summed["i"])] = np.asarray(summed["v"])
    out = out.reshape(k + 1, k) / mean.n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max(initial=0.0))


def _deviation(x: np.ndarray, mean: Centre) -> pa.Array:
    """Sum of (n x - S)^2: integers that wrap around are exact where the sum fits a long; null where it does not."""
    with np.errstate(over="ignore"):
        part = (x - mean.whole) * np.int64(mean.n) - mean.rest
        exact = (part * part).sum(1)
    rough = ((mean.shifted(x) * mean.n) ** 2).sum(1)
    out = exact.astype(object) if (rough > 2.0**62).any() else exact
    for i in np.flatnonzero(rough > 2.0**62):
        true = sum(((int(a) - int(q)) * mean.n - int(r)) ** 2 for a, q, r in zip(x[i], mean.whole, mean.rest)) if rough[i] < 2.0**64 else 2**63
        out[i] = true if true < 2**63 else None
    return pa.array(out, pa.int64())


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error, residual: a row for each usable vector and component.

    Rows whose vector is null, empty, or holds a null, NaN or infinity are left out, and so are vectors of another length
    than the commonest. A repeated row counts each time and gives its rows each time; a null id stays null; other columns
    are ignored. Directions without variance have no rows, so there are fewer components than asked for where the
    vectors span less, and no rows at all for an empty table or one of equal vectors. ``deviation`` is null where it
    exceeds a long.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    x = scratch.keep(fit_list(quantize(rows, id_col, vec_col)), "x")
    kind = rows.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error", "residual"))])
    mean = centre(x)
    found = lobpcg(x, mean, components) if mean else None
    if found is None or not len(found.variances):
        return spark.createDataFrame([], schema)
    error = identity_error(x, mean, found)
    k = len(found.variances)
    share, residuals = found.variances / found.total, found.residuals

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                m = _matrix(part.column("x"))
                r = len(m)
                each = np.repeat(np.arange(r), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, mean.n)), _deviation(m, mean).take(pa.array(each)),
                        pa.array(_project(m, mean, found).ravel()), pa.array(np.tile(share, r)), pa.array(np.full(r * k, error)), pa.array(np.tile(residuals, r)),
                    ],
                    [f.name for f in schema],
                )

    return x.mapInArrow(emit, schema)
