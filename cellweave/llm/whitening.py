"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import column_of
from cellweave.session import stored

LARGEST = 2.0**40  # components beyond are moved to this bound before they become whole numbers
TASK_CELLS = 8_000_000  # components that one task of a pass reads, about
REDUCED = 1_000_000  # partial sums that one reducer adds up, about
NONE_LEFT = 1e-13  # part of the trace up to which an eigenvalue counts as rounding


def whole_numbers(vectors: DataFrame, step: int = 64, shift: int = 1_000_000) -> DataFrame:
    """`vec_id` and `x`, each component c as the whole number floor(step * c) + shift.

    Left out are null and empty vectors, vectors with null, NaN or infinite components, and those whose length is
    not the most frequent one (ties: the longer). Components beyond 2^40 / step count as that bound.
    """
    found = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    found = found.where(F.col("e").isNotNull() & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    size = found.where("size(e) > 0").groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    found = found.where(F.size("e") == (size[0]["n"] if size else -2))
    bounded = lambda c: F.greatest(F.least(c * F.lit(float(step)), F.lit(LARGEST)), F.lit(-LARGEST))
    return found.select("vec_id", F.transform("e", lambda c: F.floor(bounded(c)) + F.lit(shift).cast("long")).alias("x"))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    x = column_of(batch, "x")
    return x.flatten().to_numpy().reshape(len(x), -1)


def _summed(fit: DataFrame, partial: Callable[[np.ndarray], np.ndarray], kind: str, cells: int, tasks: int) -> np.ndarray:
    """Sum over all rows of `fit`, read by `tasks` tasks, of what `partial` gives for a block of rows: `cells` numbers.

    Each task adds its blocks up, and the tasks' sums meet by place, so that no task or driver holds all of them.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                some = partial(_rows(batch))
                total = some if total is None else total + some
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    # A task gives one row a place, so there is nothing to combine before the shuffle: few small sums need few reducers.
    reducers = min(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + tasks * cells // REDUCED)
    found = fit.mapInArrow(kernel, f"place long, value {kind}").repartition(reducers, "place")
    sums = found.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(sums.num_rows, dtype=np.int64 if kind == "long" else np.float64)
    out[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return out


@dataclass(frozen=True)
class Covariance:
    """The covariance of the fit list (divisor n) as an operator; it is never formed."""

    fit: DataFrame
    n: int
    sums: np.ndarray  # whole numbers
    tasks: int = 1

    @property
    def size(self) -> int:
        return len(self.sums)

    def times(self, q: np.ndarray) -> np.ndarray:
        """One pass: XᵀXQ / n for the centred rows X. Centring is exact up to one rounding of each entry."""
        n, sums, sent = self.n, self.sums, self.fit.sparkSession.sparkContext.broadcast(np.ascontiguousarray(q))

        def partial(x: np.ndarray) -> np.ndarray:
            c = (n * x - sums) / n
            return (c.T @ (c @ sent.value)).ravel()

        return _summed(self.fit, partial, "double", q.size, self.tasks).reshape(q.shape) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(_summed(self.fit, lambda x: np.array([(((n * x - sums) / n) ** 2).sum()]), "double", 1, self.tasks)[0]) / n


def _lanczos(cov: Covariance, steps: int, rng: np.random.Generator) -> tuple[float, float]:
    """Estimates of the smallest eigenvalue, less its residual, and of the largest one."""
    q, before, beta, a, b = rng.standard_normal(cov.size), np.zeros(cov.size), 0.0, [], []
    q /= np.linalg.norm(q)
    for _ in range(min(steps, cov.size)):
        w = cov.times(q[:, None])[:, 0] - beta * before
        a.append(float(q @ w))
        w -= a[-1] * q
        beta = float(np.linalg.norm(w))
        b.append(beta)
        if beta <= 1e-12 * max(map(abs, a)):
            break
        before, q = q, w / beta
    values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))
    return max(0.0, float(values[0] - b[-1] * abs(vectors[-1, 0]))), float(values[-1])


@dataclass(frozen=True)
class Components:
    """Unit eigenvectors as columns, by falling eigenvalue, with the norms of their residuals and the passes made."""

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(cov: Covariance, count: int, guard: int = 16, rounds: int = 60, seed: int = 1) -> Components:
    """The `count` leading eigenpairs by Chebyshev-filtered subspace iteration.

    A round runs the three-term Chebyshev recurrence, one pass a degree, which grows what lies above the unwanted
    interval [smallest eigenvalue, smallest Ritz value of the block] and damps the rest; QR and Rayleigh-Ritz follow.
    The degree follows from the gap. Certified are residuals at the level of rounding that a further round, in
    which a fresh random direction joins the block, leaves unchanged. Raises RuntimeError if that is not reached.
    """
    d, rng, passes = cov.size, np.random.default_rng(seed), 0
    k, count = min(d, count + guard), min(d, count)
    low, top = _lanczos(cov, 6, rng) if k < d else (0.0, 0.0)
    passes += min(6, d) if k < d else 0
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    best, calm, sure = math.inf, 0, False
    for _ in range(rounds):
        vq = cov.times(q)
        passes += 1
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)
        worst, scale = float(residuals[:count].max()), max(float(values[0]), 1e-300)
        calm = calm + 1 if worst > best / 2 else 0
        best = min(best, worst)
        fine = worst <= 2e-13 * scale or (worst <= 1e-11 * scale and calm)
        if k == d or (fine and sure):
            return Components(_signed(q[:, :count]), values[:count], residuals[:count], passes)
        x, vx = q.copy(), vq.copy()
        sure = fine
        if fine:  # a direction that was missed would show up in the next round
            p = rng.standard_normal(d)
            p -= q @ (q.T @ p)
            x[:, -1] = p / np.linalg.norm(p)
            vx[:, -1] = cov.times(x[:, -1:])[:, 0]
            passes += 1
        edge = float(values[-1])
        half, middle, top = max((edge - low) / 2, 1e-9 * scale), (edge + low) / 2, max(top, scale)
        reach = max((float(values[count - 1]) - middle) / half, 1.0 + 1e-6)
        growth = math.log(reach + math.sqrt(reach * reach - 1))
        degree = int(np.clip(math.ceil(math.log(1e6) / growth), 3, 30))
        first = half / (top - middle)
        sigma, y = first, (vx - middle * x) * (first / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            x, y = y, (cov.times(y) - middle * y) * (2 * after / half) - x * (sigma * after)
            sigma = after
            passes += 1
        q = np.linalg.qr(y / np.linalg.norm(y, axis=0))[0]
    raise RuntimeError(f"components not certified after {passes} passes: residual {best}")


def _signed(vectors: np.ndarray) -> np.ndarray:
    """The largest entry of each column positive."""
    largest = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """Fitted components: `scale` is 1 / sqrt(eigenvalue), NaN where the eigenvalue is not above rounding."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    scale: np.ndarray
    trace: float
    identity_error: float
    passes: int


def fit_whitening(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on every distinct vector `x` of `rows` once; None without any row."""
    fit = stored(rows.select("x").distinct(), "fit-list")
    counted = _summed(fit, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "long", 1, 1)
    if not len(counted):
        return None
    # Every pass reads the list again: few files of a fair size, whatever number the shuffle left.
    tasks = max(fit.sparkSession.sparkContext.defaultParallelism, int(counted[0]) * (len(counted) - 1) // TASK_CELLS)
    fit = stored(fit.coalesce(tasks), "fit-list")
    cov = Covariance(fit, int(counted[0]), counted[1:], tasks)
    trace = cov.trace()
    found = leading(cov, components)
    values = np.maximum(found.values, 0.0)
    scale = np.where(values > NONE_LEFT * trace, 1 / np.sqrt(np.where(values > 0, values, 1.0)), np.nan)
    n, sums, turn = cov.n, cov.sums, (found.vectors * scale)[:, ~np.isnan(scale)]

    def moments(x: np.ndarray) -> np.ndarray:
        w = ((n * x - sums) / n) @ turn
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    m = turn.shape[1]
    error = 0.0
    if m:
        sums_w = _summed(fit, moments, "double", m * (m + 1), tasks) / n
        error = float(np.abs(sums_w[m:].reshape(m, m) - np.outer(sums_w[:m], sums_w[:m]) - np.eye(m)).max())
    return Whitening(n, sums, found.vectors, values, scale, trace, error, found.passes)


def _squares(z: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows; null where one does not fit 64 bits."""
    if (z.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return (z * z).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in z.tolist()]
    return [v if v < 2**63 else None for v in exact]


def _project(batches: Iterator[pa.RecordBatch], fitted: Whitening) -> Iterator[pa.RecordBatch]:
    t = len(fitted.values)
    explained = fitted.values / fitted.trace if fitted.trace else np.zeros(t)
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        z = fitted.n * _rows(batch) - fitted.sums
        w = ((z / fitted.n) @ fitted.vectors * fitted.scale).ravel()
        yield pa.RecordBatch.from_arrays(
            [
                column_of(batch, "vec_id").take(pa.array(np.repeat(np.arange(rows), t))),
                pa.array(np.tile(np.arange(1, t + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * t, fitted.n)),
                pa.array(_squares(z), pa.int64()).take(pa.array(np.repeat(np.arange(rows), t))),
                pa.array(w, mask=np.isnan(w)),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * t, fitted.identity_error)),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Project every vector (`vec_id`, `embedding`) on the leading components of the whole-number vectors.

    Returns for each remaining row and component (from 1, by falling eigenvalue, at most `components` and the length
    of the vectors): vec_id, component, n (distinct vectors), deviation (sum over dimensions of (n * x - S)^2, exact;
    null beyond 64 bits), whitened, explained (eigenvalue / trace), identity_error (largest absolute entry of the
    covariance of `whitened` over the distinct vectors, minus the identity).

    Which vectors remain is told at `whole_numbers`. Zero vectors remain; null and repeated vec_ids and repeated
    rows keep their rows, but equal vectors count once for the fit. Components whose eigenvalue is not above
    rounding have null whitened and are left out of identity_error. An empty table gives no rows; other columns are
    ignored. A vector's length times the number of components is what the driver holds.
    """
    rows = stored(whole_numbers(vectors), "whole-vectors")
    fitted = fit_whitening(rows, components)
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([rows.schema["vec_id"], *[T.StructField(n, t) for n, t in fields]])
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(lambda b: _project(b, fitted), schema)
