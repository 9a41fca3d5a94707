"""Logistic models of many groups at once: Newton steps whose sums come from one aggregation a step."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import sigmoid
from cellweave.session import stored

#: Models that may be fitted at once: the driver holds (features + 1)^2 numbers for each.
MODELS = 5_000


@dataclass
class _Model:
    """One model's last accepted terms, the terms being tried, and what the last aggregation said."""

    active: np.ndarray  # places of its terms among all, the bias first
    tried: np.ndarray
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loss: float = np.inf
    done: bool = False

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, tolerance: float) -> None:
        """Accept the tried terms if they lower the loss, and try a Newton step from them; halve the step otherwise."""
        if loss <= self.loss + 1e-12 * abs(self.loss if np.isfinite(self.loss) else 0.0):
            self.terms, self.loss = self.tried.copy(), loss
            a = self.active
            step = np.zeros_like(self.tried)
            step[a] = np.linalg.lstsq(hessian[np.ix_(a, a)], gradient[a], rcond=None)[0]
            self.done = bool(np.abs(step).max() <= tolerance * (1 + np.abs(self.terms).max()))
            self.tried = self.terms - step
        else:
            self.tried = (self.terms + self.tried) / 2
            self.done = bool(np.abs(self.tried - self.terms).max() <= tolerance * (1 + np.abs(self.terms).max()))


def linear(features: Sequence[str], terms: Column) -> Column:
    """Bias and weighted features; `terms` is an array with the bias first."""
    total = terms[0]
    for i, f in enumerate(features):
        total = total + terms[i + 1] * F.col(f)
    return total


def _same(rows: DataFrame, side: DataFrame, by: Sequence[str], prefix: str, groups: Iterable[tuple]) -> Column:
    """Equal values of `by`, nulls included; without nulls among the groups the cheaper equality finds the same rows."""
    plain = all(value is not None for key in groups for value in key[: len(by)])
    match = F.lit(True)
    for k in by:
        match = match & (rows[k] == side[f"{prefix}{k}"] if plain else rows[k].eqNullSafe(side[f"{prefix}{k}"]))
    return match


def with_models(rows: DataFrame, features: Sequence[str], by: Sequence[str], fitted: Mapping[tuple, Sequence[float]]) -> DataFrame:
    """Each row once for every model of its group: columns `variant` and `_terms` are added.

    `fitted` maps (values of `by`..., variant) to terms; the table of models is a constant of at most MODELS rows.
    """
    if len(fitted) > MODELS:
        raise ValueError(f"{len(fitted)} models are more than are fitted at once")
    fields = ", ".join([*(f"`_m_{k}` {rows.schema[k].dataType.simpleString()}" for k in by), "variant string", "_terms array<double>"])
    table = rows.sparkSession.createDataFrame([(*key, [float(t) for t in terms]) for key, terms in fitted.items()], fields)
    if not by:
        return rows.select("*", F.explode(F.array(*[F.struct(F.lit(k[-1]).alias("variant"), F.array(*[F.lit(float(x)) for x in t]).alias("_terms")) for k, t in fitted.items()])).alias("_m")).select(*rows.columns, "_m.variant", "_m._terms")
    return rows.join(F.broadcast(table), _same(rows, table, by, "_m_", fitted)).drop(*[f"_m_{k}" for k in by])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of one group: its number, and the columns as doubles, one after the other."""
    for batch in batches:
        group, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(group, kind="stable")
        group, table = group[order], np.vstack(columns)[:, order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        blocks = [table[:, s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(group)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(group[starts], pa.int32()), pa.array(blocks, pa.binary())], ["_g", "_rows"])


def _sums(batches: Iterator[pa.RecordBatch], tried: Mapping[int, np.ndarray], columns: int, upper: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Per group and model: sums of weight, loss, gradient and upper triangle of the Hessian over a task's blocks.

    `tried` has a row of terms for each model of a group; groups without models are passed over.
    """
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for g, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if g not in tried:
                continue
            y, w, *features = np.frombuffer(block.as_buffer(), np.float64).reshape(columns, -1)
            x = np.vstack([np.ones(len(y)), *features])
            z = tried[g] @ x
            small = np.exp(-np.abs(z))  # never overflows
            p = np.where(z >= 0, 1.0, small) / (1 + small)
            loss = np.maximum(z, 0) - z * y + np.log1p(small)
            curvature = w * small / (1 + small) ** 2
            found = np.column_stack([np.full(len(z), w.sum()), loss @ w, (w * (p - y)) @ x.T, curvature @ (x[upper[0]] * x[upper[1]]).T])
            totals[g] = totals[g] + found if g in totals else found
    for g, found in totals.items():
        models = pa.array(range(len(found)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([g] * len(found), pa.int32()), models, pa.array(list(found), pa.list_(pa.float64()))], ["_g", "_m", "_s"])


def fit_logistic_groups(
    rows: DataFrame, features: Sequence[str], by: Sequence[str] = (), variants: Mapping[str, Sequence[str]] | None = None,
    label: str = "label", weight: str = "weight", l2: float = 1e-4, steps: int = 60, tolerance: float = 1e-10,
) -> dict[tuple, list[float]]:
    """Weighted logistic models of every group of `rows` and every variant: (by values..., variant) -> terms.

    Terms are the bias and a weight for each of `features`; a variant (name -> its features) has 0 for the others. Each model
    minimises the weighted mean of its log-loss plus l2 / 2 times the squares of its weights. The rows are written once, in
    blocks of one group each. A step is one pass over the blocks that sums loss, gradient and Hessian of all models that have
    not converged, so the number of passes is that of the slowest model. Steps that do not lower the loss are halved. Rows with
    null features, label or weight take no part; groups without a row have no model.
    """
    variants = {"full": list(features)} if variants is None else variants
    ready = rows.where(F.col(weight) > 0).dropna(subset=[*features, label])
    d = len(features) + 1
    place = {f: i + 1 for i, f in enumerate(features)}
    groups = [tuple(r[k] for k in by) for r in ready.select(*by).distinct().collect()] if by else [()] * bool(ready.head(1))
    models = {(*g, v): _Model(np.array([0, *[place[f] for f in fs]]), np.zeros(d)) for g in groups for v, fs in variants.items()}
    if len(models) > MODELS:
        raise ValueError(f"{len(models)} models are more than are fitted at once")
    if not models:
        return {}

    spark = rows.sparkSession
    fields = ", ".join([*(f"`_k_{k}` {rows.schema[k].dataType.simpleString()}" for k in by), "_g int"])
    numbered = F.broadcast(spark.createDataFrame([(*key, g) for g, key in enumerate(groups)], fields))
    numbers = [F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate([label, weight, *features])]
    blocks = stored(ready.join(numbered, _same(ready, numbered, by, "_k_", groups)).select("_g", *numbers).mapInArrow(_pack, "_g int, _rows binary"), "blocks")

    upper = np.triu_indices(d)
    sums = [F.sum(F.get("_s", F.lit(i))).alias(f"_s{i}") for i in range(2 + d + len(upper[0]))]
    for _ in range(steps):
        open_ = {g: [(*key, v) for v in variants if not models[(*key, v)].done] for g, key in enumerate(groups)}
        tried = {g: np.array([models[k].tried for k in keys]) for g, keys in open_.items() if keys}
        if not tried:
            break
        step = partial(_sums, tried=tried, columns=len(numbers), upper=upper)
        parts = blocks.mapInArrow(step, "_g int, _m int, _s array<double>")
        for r in parts.groupBy("_g", "_m").agg(*sums).collect():  # one row a model
            m = models[open_[r["_g"]][r["_m"]]]
            n, loss, *rest = r[2:]
            penalty = np.full(d, l2)
            penalty[0] = 0.0
            gradient = np.array(rest[:d]) / n + penalty * m.tried
            hessian = np.zeros((d, d))
            hessian[upper] = hessian.T[upper] = np.array(rest[d:]) / n
            m.take(loss / n + float((penalty * m.tried**2).sum()) / 2, gradient, hessian + np.diag(penalty), tolerance)
    return {k: m.terms.tolist() for k, m in models.items()}


def score_logistic(rows: DataFrame, features: Sequence[str], by: Sequence[str], fitted: Mapping[tuple, Sequence[float]], name: str = "score") -> DataFrame:
    """Rows once for every model of their group, with `variant` and the probability."""
    return with_models(rows, features, by, fitted).withColumn(name, sigmoid(linear(features, F.col("_terms")))).drop("_terms")
