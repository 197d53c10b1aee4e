"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors are quantised to whole numbers, and the different ones are fitted. Their
covariance V is never formed: a pass over the fit list gives V times a narrow block,
as sums of each task's centred products. A polynomial recurrence of such passes
damps the unwanted part of the spectrum; QR and a Rayleigh-Ritz step follow, until the
residuals of the wanted pairs certify them. Only matrices of a vector's length times the
block's width reach the driver, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

COMPONENTS, SCALE = 4, 256
#: Columns beside the wanted ones, degree of the filter, steps that bound the spectrum, rounds at most.
GUARD, DEGREE, BOUND_STEPS, ROUNDS = 12, 12, 8, 60
#: A pair is certified when its residual is under TOLERANCE of the largest eigenvalue; after ROUNDS, under LOOSE, or else an error.
TOLERANCE, LOOSE = 1e-13, 1e-9
#: Scaled entries of this size or more are out of range.
LARGEST = 1 << 31


def quantised(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds no null or non-finite entry, with x: floor(SCALE * entry) as ints; null where an entry is out of range."""
    v = F.col(vector_col)
    whole = F.coalesce(v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall(v, lambda c: F.abs(c.cast("double") * SCALE) < LARGEST)
    return vectors.where(whole).withColumn("x", F.when(fits, F.transform(scaled, lambda c: c.cast("int"))))


def _rows(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, d)


def _summed(fit: DataFrame, d: int, out_rows: int, width: int, kind: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (out_rows x width) over batches of the fit list's vectors: within tasks first, then by row."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches):
        total = np.zeros((out_rows, width), dtype)
        for batch in batches:
            total += part(_rows(batch.column("x"), d))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out_rows), pa.int32()), lists.cast(pa.list_(lists.type.value_type))], names=["i", "v"])

    sums = fit.select("x").mapInArrow(run, f"i int, v array<{kind}>").groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(width)])
    found = np.zeros((out_rows, width), dtype)
    for r in sums.toArrow().to_pylist():
        found[r["i"]] = [r[f"c{j}"] for j in range(width)]
    return found


class Covariance:
    """The covariance of a fit list (x) of vectors of length d, as an operator: ``times`` is a pass over the list."""

    def __init__(self, fit: DataFrame, d: int) -> None:
        self.fit, self.d = fit, d
        got = _summed(fit, d, d + 1, 1, "long", lambda x: np.append(x.sum(0, dtype=np.int64), len(x))[:, None])[:, 0]
        self.sums, self.n = got[:d], int(got[d])
        self.mean = self.sums / self.n
        self.trace = float(self._pass(lambda c: (c * c).sum(keepdims=True), 1, 1)[0, 0]) / self.n

    def _pass(self, part: Callable[[np.ndarray], np.ndarray], out_rows: int, width: int) -> np.ndarray:
        mean = self.mean
        return _summed(self.fit, self.d, out_rows, width, "double", lambda x: part(x - mean))

    def times(self, q: np.ndarray) -> np.ndarray:
        return self._pass(lambda c: c.T @ (c @ q), self.d, q.shape[1]) / self.n


def _lowest(v: Covariance, rnd: np.random.Generator) -> float:
    """About the least eigenvalue, and rather less: the least Ritz value of a few Lanczos steps minus the last step's norm."""
    basis, alpha, beta = [], [], []
    q = rnd.standard_normal(v.d)
    q /= np.linalg.norm(q)
    for _ in range(min(BOUND_STEPS, v.d)):
        basis.append(q)
        w = v.times(q[:, None])[:, 0]
        alpha.append(q @ w)
        for b in basis:
            w -= (b @ w) * b
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        q = w / beta[-1]
    return max(0.0, np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))[0] - beta[-1])


def _filtered(v: Covariance, q: np.ndarray, low: float, cut: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of V times q, at most one on [low, cut] and large above; scaled by its size at ``top``."""
    centre, half = (cut + low) / 2, (cut - low) / 2
    first = scale = half / (top - centre)
    y = (v.times(q) - centre * q) * (scale / half)
    for _ in range(2, DEGREE + 1):
        following = 1 / (2 / first - scale)
        q, y = y, 2 * (v.times(y) - centre * y) * (following / half) - scale * following * q
        scale = following
    return y


def leading_components(v: Covariance, k: int = COMPONENTS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (columns), certified by their residuals.

    Eigenvectors of equal eigenvalues are any orthonormal ones of their space. Each
    round's filter damps all below the block's least Ritz value, so a direction of a
    larger eigenvalue that the block lacks grows in it until it is found.
    """
    width, rnd = min(v.d, k + GUARD), np.random.default_rng(seed)
    q = np.linalg.qr(rnd.standard_normal((v.d, width)))[0] if width < v.d else np.eye(v.d)
    low = _lowest(v, rnd) if width < v.d else 0.0
    best = None
    for _ in range(ROUNDS):
        vq = v.times(q)
        small = q.T @ vq
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        q, vq = q @ y, vq @ y
        worst = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max()
        if best is None or worst < best[0]:
            best = worst, values[:k], q[:, :k]
        if worst <= TOLERANCE * values[0] or values[0] <= 0 or width == v.d:
            break
        cut = max(values[-1], 1e-12 * values[0])
        if values[0] - cut <= 1e-12 * values[0]:
            break  # the whole block belongs to one eigenvalue
        q = np.linalg.qr(_filtered(v, q, min(low, 0.9 * cut), cut, values[0]))[0]
    worst, values, vectors = best
    if worst > LOOSE * max(values[0], 1e-300):
        raise ArithmeticError(f"components were not certified: residual {worst / values[0]:.1e} of the largest eigenvalue")
    return values, vectors


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n * x - sums)**2 of each row, exactly; null if no long holds it. Arithmetic modulo 2**64 is exact for those that fit."""
    about = ((x * float(n) - sums) ** 2).sum(1)
    with np.errstate(over="ignore"):
        parts = x.astype(np.int64) * n - sums
        exact = (parts * parts).sum(1)
    out: list[int | None] = exact.tolist()
    for i in np.flatnonzero(about > 9e18).tolist():
        whole = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[i], sums, strict=True)) if about[i] < 9.5e18 else 1 << 63
        out[i] = whole if whole < 1 << 63 else None
    return out


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten_length(rows: DataFrame, fit: DataFrame, d: int, components: int) -> DataFrame:
    """The whitened rows (vec_id, x) of vectors of one length."""
    k = min(components, d)
    n, sums, explained, error = 0, np.zeros(d, np.int64), np.zeros(k), 0.0
    scaled, real = np.zeros((d, k)), np.zeros(k, bool)
    mean = np.zeros(d)
    if fit.limit(1).count():
        v = Covariance(fit, d)
        values, vectors = leading_components(v, k)
        n, sums, mean = v.n, v.sums, v.mean
        real = values > 1e-9 * max(v.trace, 1e-300)
        explained = np.where(real, values / max(v.trace, 1e-300), 0.0)
        scaled = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
        if real.any():
            held = scaled[:, real]
            centre = v._pass(lambda c: (c @ held).sum(0)[:, None], held.shape[1], 1)[:, 0] / n
            gram = v._pass(lambda c: (c @ held - centre).T @ (c @ held - centre), held.shape[1], held.shape[1]) / n
            error = float(np.abs(gram - np.eye(len(gram))).max())

    def run(batches):
        for batch in batches:
            m, col = batch.num_rows, batch.column("x")
            there = np.asarray(col.is_valid())
            x = _rows(col.drop_null(), d)
            deviation, w = np.full(m, None, object), np.full((m, k), np.nan)
            deviation[there], w[there] = _deviation(x, n, sums), (x - mean) @ scaled
            flat = pa.array(w.ravel(), mask=~(there[:, None] & real).ravel())
            each = lambda v: pa.array(np.tile(v, m))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k).tolist(), pa.int64()), flat, each(explained), pa.array(np.full(m * k, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, _OUT)


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each row its coordinates on the leading components, of variance one.

    Rows whose vector is null or holds null or non-finite entries are left out; equal
    vectors are fitted once, and rows that repeat an id come back each. Vectors of
    different lengths are whitened apart, on components of their own, as many as the
    length at most; empty vectors have none. Rows with an entry of LARGEST or more after
    scaling are not fitted; their deviation and whitened are null. A component without
    variance (one different vector, or fewer than components) has explained 0 and
    whitened null. deviation is null where no long holds it. Other columns are left out,
    so their names can't clash; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    q = quantised(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")), "v").withColumn("size", F.size("v")).where("size > 0").drop("v")
    fit = written(q.where("x is not null").select("size", "x").distinct())
    sizes = sorted(r[0] for r in q.select("size").distinct().collect())  # one fit each, of which a job has few
    out = spark.createDataFrame([], _OUT)
    for d in sizes:
        part = _whiten_length(q.where(F.col("size") == d).select("vec_id", "x"), fit.where(F.col("size") == d), d, components)
        out = part if d == sizes[0] else out.unionByName(part)
    return out
