"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never made. A block of ``BLOCK`` directions Q is multiplied with it in one
distributed pass, V Q = X' (X Q) / n over the centred distinct vectors X, of which a task gives d
rows of sums; only such d by ``BLOCK`` sums reach the driver, so its work follows the number of
dimensions and not that of rows. A cycle runs the three-term Chebyshev recurrence over such passes, which
damps all of the spectrum between a lower bound, from a few Lanczos steps, and the smallest Ritz value of
the block; then QR and Rayleigh-Ritz. The first ``k`` Ritz pairs are certified by their residuals
|V q - e q|. If ``PASSES`` passes do not get there the block is doubled, up to all dimensions, where
Rayleigh-Ritz alone is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainproof.llm.common import written

#: Directions that are iterated, and passes before there are twice as many.
BLOCK, PASSES = 16, 240
#: Residuals, as a share of the largest eigenvalue, that certify; and that do once they fall no further.
CERTIFIED, ROUNDED = 2e-14, 1e-12
#: Lanczos steps that bound the spectrum from below.
STEPS = 10
#: Eigenvalues up to this share of the largest count as zero.
ZERO = 1e-12
#: Degree of the filter at most, and how much more it may amplify the first than the last wanted direction.
DEGREE, APART = 12, math.log(1e10)

_MOST = (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * c)`` of each entry as a long (the nearest, where none is as large); null for a vector
    that is null or holds a null or non-finite entry."""
    y = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(y(c)) | (F.abs(y(c)) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * y(c)).cast("long")))


def _rows(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            yield np.asarray(batch.column("x").slice(at, 4096).flatten()).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors (x) and their exact sum in each of ``d`` dimensions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for x in _rows(batches, d):
            safe = float(np.abs(x.astype(float)).max(initial=0)) * len(x) < 1 << 62
            own = x.sum(0) if safe else x.astype(object).sum(0)
            total, n = [a + int(b) for a, b in zip(total, own, strict=True)], n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["i", "s"])

    rows = dict(map(tuple, fit.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s")).collect()))  # d + 1
    return int(rows.get(-1, 0)), [int(rows.get(i, 0)) for i in range(d)]


def _summed(fit: DataFrame, d: int, mean: np.ndarray, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``part`` (a matrix of the given shape) over blocks of the centred vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _rows(batches, d):
            total += part(x - mean)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1) * shape[1], pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), flat], names=["i", "y"])

    sums = [F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(shape[1])]
    out = np.zeros(shape)
    for i, *y in fit.mapInArrow(add, "i int, y array<double>").groupBy("i").agg(*sums).collect():  # as many rows as dimensions
        out[i] = y
    return out


def lower_bound(times: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator) -> float:
    """A number that the smallest eigenvalue is hardly under: the smallest Ritz value of ``STEPS`` Lanczos steps, less
    the last off-diagonal. Where it is too high, the block shows a smaller Ritz value later."""
    basis, alphas, betas = [rng.standard_normal(d)], [], []
    basis[0] /= np.linalg.norm(basis[0])
    for _ in range(min(STEPS, d)):
        w = times(basis[-1].reshape(-1, 1))[:, 0]
        alphas.append(float(w @ basis[-1]))
        for q in [*basis, *basis]:  # twice: orthogonal to rounding
            w = w - (w @ q) * q
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    off = betas[: len(alphas) - 1]
    return max(0.0, float(np.linalg.eigvalsh(np.diag(alphas) + np.diag(off, 1) + np.diag(off, -1))[0]) - betas[-1])


def _degree(theta: np.ndarray, k: int, low: float, high: float) -> int:
    middle, half = (high + low) / 2, (high - low) / 2
    rate = lambda e: math.acosh(max(1.0, (e - middle) / half))
    first, last = rate(theta[0]), rate(theta[k - 1])
    return int(np.clip(min(APART / max(first - last, 1e-9), math.log(1e8) / max(last, 1e-9)), 2, DEGREE))


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the matrix, on [low, high], times q; scaled so that it is about one at ``top``."""
    middle, half = (high + low) / 2, (high - low) / 2
    first = sigma = half / (top - middle)
    before, now = q, (times(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now, sigma = now, (times(now) - middle * now) * (2 * after / half) - sigma * after * before, after
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues of a positive semidefinite matrix, their unit eigenvectors (d, k), and the largest
    residual as a share of the first eigenvalue. ``times`` multiplies the matrix with a (d, m) block."""
    rng, passes = np.random.default_rng(13), 0
    p = min(d, max(block, 2 * k))
    q = np.eye(d) if p == d else np.linalg.qr(rng.standard_normal((d, p)))[0]
    low = None if p < d else 0.0
    before, limit = math.inf, PASSES
    while True:
        w = times(q)
        inner = q.T @ w
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        passes += 1
        rest = float(np.linalg.norm(w[:, :k] - q[:, :k] * theta[:k], axis=0).max()) / max(theta[0], 1e-300)
        stuck = rest > before / 2 and rest < ROUNDED
        if theta[0] <= 0 or p == d or rest <= CERTIFIED or stuck:
            return theta[:k], q[:, :k], rest
        before = rest
        if passes >= limit:
            p, limit = min(d, 2 * p), limit + PASSES
            q = np.eye(d) if p == d else np.linalg.qr(np.hstack([q, rng.standard_normal((d, p - q.shape[1]))]))[0]
            continue
        if low is None:
            low = lower_bound(times, d, rng)
        low = min(low, 0.99 * max(float(theta[-1]), 0.0))
        high = max(float(theta[-1]), low + 1e-12 * theta[0])
        degree = _degree(theta, k, low, high)
        q = np.linalg.qr(_filtered(times, q, degree, low, high, float(theta[0])))[0]
        passes += degree


def whiten(docs: DataFrame, k: int = 4, *, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """For each row whose vector has only finite entries, and each of the first ``k`` components (or as many as there are
    dimensions): vec_id, component (int, from 1), n, deviation, whitened, explained, identity_error.

    Everything is fitted on each distinct quantised vector once. Vectors count as ending in zeros where others are longer.
    Null and repeated keys are rows of their own. A component without variance (fewer distinct vectors than components)
    cannot be whitened: its ``whitened`` is null and it does not count in ``identity_error``; where no component has any,
    ``explained`` and ``identity_error`` are null too. A ``deviation`` that no long holds is the largest long. Vectors without entries, and an
    empty table, give no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector}`"), scale).alias("x")).where("x is not null")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(rows, "vectors")
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return spark.createDataFrame([], schema)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    rows = rows.withColumn("x", padded)
    fit = written(rows.select("x").distinct(), "fit")
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])
    trace = float(_summed(fit, d, mean, lambda c: np.array([[np.einsum("ij,ij->", c, c)]]), (1, 1))[0, 0]) / n
    k = min(k, d)

    def times(q: np.ndarray) -> np.ndarray:
        return _summed(fit, d, mean, lambda c: c.T @ (c @ q), q.shape) / n

    e, axes, _ = leading(times, d, k)
    real = int((e > ZERO * max(e[0], 0.0)).sum()) if trace > 0 else 0
    scaled = axes[:, :real] / np.sqrt(e[:real])
    error = None
    if real:
        centre = _summed(fit, d, mean, lambda c: (c @ scaled).sum(0).reshape(1, -1), (1, real)) / n

        def outer(c: np.ndarray) -> np.ndarray:
            w = c @ scaled - centre
            return w.T @ w

        error = float(np.abs(_summed(fit, d, mean, outer, (real, real)) / n - np.eye(real)).max())
    shared = spark.sparkContext.broadcast((n, sums, mean, scaled))  # a few numbers for each dimension

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, scaled = shared.value
        most = max(map(abs, sums))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
                reach = n * max(int(x.max()), -int(x.min())) + most
                if reach * reach * d <= _MOST:
                    z = n * x - np.array(sums, np.int64)
                    deviation = (z * z).sum(1)
                else:
                    deviation = np.array([min(_MOST, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x.tolist()], np.int64)
                w = np.full((len(x), k), np.nan)
                w[:, : scaled.shape[1]] = (x - mean) @ scaled
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation), lists], names=["vec_id", "deviation", "w"])

    out = rows.mapInArrow(project, "vec_id long, deviation long, w array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
    share = F.array(*[F.lit(float(max(v, 0.0)) / trace if trace > 0 else None).cast("double") for v in e])
    return out.select(
        "vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("c")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
