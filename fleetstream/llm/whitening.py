"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of a covariance V are found without forming V: a pass
over the vectors multiplies a narrow block Q by it, as the sum of
(x - mean)((x - mean)' Q) / n over partitions. A few Lanczos passes give safe
bounds of the spectrum. Each round then applies a Chebyshev polynomial of V,
one pass per degree by the three-term recurrence, that is small on the interval
of unwanted eigenvalues and grows fast above it; QR makes the block orthonormal
again and Rayleigh-Ritz takes the eigenvectors of the small projected matrix.
Rounds go on until the residuals |V q - e q| are at the level of rounding.

The driver holds blocks of d x ``BLOCK`` numbers, d being the dimension. What
tasks return is added up by row of the block on the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstream.session import stage

#: Columns of the iterated block beyond the components asked for, degree of the polynomial, Lanczos passes.
GUARD, DEGREE, LANCZOS = 12, 12, 10
#: Certified: residual of each component, as a share of the largest eigenvalue. Rounds end there, or at ROUNDS.
RESIDUAL, ROUNDS = 1e-14, 60
#: An eigenvalue below this share of the trace is zero up to rounding: such a direction can't be whitened.
NOTHING = 1e-13
SEED = 11


def quantized(vector: Column) -> Column:
    """x = floor(256 * c) + 0 of each entry c, as longs; null if the vector is null or holds null or non-finite entries.

    The limits of a double are compared, so infinities and NaN fail alike.
    """
    c = vector.cast("array<double>")
    finite = F.forall(c, lambda v: F.coalesce((F.abs(v) <= 1.7976931348623157e308) & ~F.isnan(v), F.lit(False)))
    return F.when(finite, F.transform(c, lambda v: F.floor(v * 256) + F.lit(0).cast("long")))


@dataclass
class Fit:
    """Distinct vectors (x), their number, exact sums, leading eigenpairs by falling eigenvalue, trace, and certificates."""

    vectors: DataFrame
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray  # d x components
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n; n * x - S is exact as long as it stays below 2 ** 53."""
    return (x * n - sums) / n


def summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over all vectors of ``part`` (rows of a batch to a matrix); a row of the matrix is added up by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0), d))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.mapInArrow(run, "i long, row array<double>")
    columns = F.posexplode("row").alias("j", "v")
    rows = parts.select("i", columns).groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row"))
    found = sorted((r["i"], [c["v"] for c in r["row"]]) for r in rows.collect())
    return np.array([row for _, row in found])


def _bounds(apply: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator) -> tuple[float, float]:
    """Numbers at or below and at or above all eigenvalues, by Lanczos: outer Ritz values and the norm of the last residual."""
    q = rng.standard_normal((d, 1))
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(LANCZOS, d)):
        w = apply(basis[-1])
        alpha.append((basis[-1].T @ w).item())
        for _ in range(2):  # full orthogonalization, twice
            for b in basis:
                w = w - b * (b.T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(abs(a) for a in alpha) or len(basis) == d:
            break
        basis.append(w / beta[-1])
    inner = beta[: len(alpha) - 1]
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(inner, 1) + np.diag(inner, -1))
    return max(0.0, ritz[0] - beta[-1]), ritz[-1] + beta[-1]


def _filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """Chebyshev polynomial of V times q, scaled to 1 at ``top``; small on [low, high]."""
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (apply(q) - centre * q) * (first / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def leading(apply: Callable[[np.ndarray], np.ndarray], d: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading eigenvalues (falling), eigenvectors and residuals of the symmetric matrix that ``apply`` multiplies by."""
    rng = np.random.default_rng(SEED)
    width = min(d, components + GUARD)
    low, high = _bounds(apply, d, rng) if width < d else (0.0, 0.0)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    best = None
    for _ in range(ROUNDS):
        v = apply(q)
        ritz, turn = np.linalg.eigh((q.T @ v + v.T @ q) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, v = q @ turn, v @ turn
        residuals = np.linalg.norm(v - q * ritz, axis=0)[:components]
        if best is None or residuals.max() < best[2].max():
            best, stalled = (ritz[:components], q[:, :components], residuals), 0
        else:
            stalled += 1
        # no better for three rounds: what is left is the rounding of the sums
        if width == d or residuals.max() <= RESIDUAL * max(ritz[0], 0) or stalled == 3:
            break
        cut = ritz[-1]
        top = max(ritz[0], cut)
        if not low < cut < top:
            low = min(low, cut * 0.5)
        if cut <= low:  # all that is left of the spectrum is zero
            break
        q = np.linalg.qr(_filtered(apply, q, low, cut, min(top, high)))[0]
    return best


def fit(vectors: DataFrame, components: int = 4) -> Fit | None:
    """Whitening of the rows' vectors (column x, arrays of longs of one length), each distinct one once; None without rows."""
    distinct = stage(vectors.select("x").distinct(), "whitening-vectors")
    totals = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).cast("string").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not totals:
        return None
    n, d = totals[0]["n"], len(totals)
    sums = [int(r["s"]) for r in sorted(totals, key=lambda r: r["i"])]
    total = np.array(sums, dtype=np.float64)
    passes = [0]

    def apply(q: np.ndarray) -> np.ndarray:
        passes[0] += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, total)
            return c.T @ (c @ q)

        return summed(distinct, part, d) / n

    trace = summed(distinct, lambda x: np.square(_centred(x, n, total)).sum(axis=0, keepdims=True), d).sum() / n
    if not trace > 0:
        return Fit(distinct, n, sums, np.empty(0), np.empty((d, 0)), 0.0, np.empty(0), 0.0, 0)
    values, axes, residuals = leading(apply, d, min(components, d))
    some = values > NOTHING * trace
    values, axes, residuals = values[some], axes[:, some], residuals[some]
    scaled = axes / np.sqrt(values)

    def whitened_part(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, total) @ scaled
        return np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])

    moments = summed(distinct, whitened_part, d) / n
    covariance = moments[:-1] - np.outer(moments[-1], moments[-1])  # the mean of w is zero up to rounding
    error = float(np.abs(covariance - np.eye(len(values))).max())
    return Fit(distinct, n, sums, values, axes, float(trace), residuals, error, passes[0])


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part.

    Left out are vectors that are null, empty, or hold null or non-finite
    entries, and those whose length is not that of most rows (of equally
    frequent lengths, the greatest): they have no place in one covariance.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), quantized(F.col(vector)).alias("x")).filter("size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (lengths["d"] if lengths else 0))


def whitened(rows: DataFrame, found: Fit | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row (vec_id, x) and component.

    A component whose eigenvalue is zero up to rounding has no row (a single
    distinct vector has none at all). The deviation is exact; it is null if it
    is beyond a long. Equal vectors, whatever their ids, have equal rows up to
    the last bits; a null vec_id stays null.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, d, total = found.n, len(found.sums), np.array(found.sums, dtype=np.float64)
    sums, scaled, share, error = found.sums, found.axes / np.sqrt(found.values), found.values / (found.trace or 1), found.identity_error
    k = len(found.values)
    limit = (1 << 63) - 1

    def deviations(x: np.ndarray) -> list[int | None]:
        widest = int(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(abs(s) for s in sums)
        if d * widest * widest <= limit:
            return np.square(x * n - np.array(sums)).sum(axis=1).tolist()
        exact = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        return [v if v <= limit else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            w, m = _centred(x.astype(np.float64), n, total) @ scaled, len(x)
            again = np.repeat(np.arange(m), k)
            deviation = pa.array(deviations(x), pa.int64()).take(pa.array(again))
            columns = [batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation]
            columns += [pa.array(w.reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """Whitened leading components of each row of ``embeddings`` that takes part (see ``usable``, ``whitened``).

    An empty table, or one without such a row, gives an empty one; repeated
    rows are rows of their own but count once in the fit; columns other than
    vec_id and the vector are not looked at.
    """
    rows = usable(embeddings, vector)
    return whitened(rows, fit(rows, components))
