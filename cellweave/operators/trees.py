"""Forests whose sample, told by its thresholds, fits a task: it goes to every task, and the trees are dealt over the tasks.

Spark ML sums a dense histogram for every node of every level; at depth 30, most nodes hold a few rows, and their histograms
are many times the sample. Here a tree is grown level by level on its own bootstrap counts, each feature's rows being kept in
order within their nodes, so that a level costs one pass over the rows that are still in question. The rules are Spark ML's:
thresholds at 31 weighted quantiles, a look at the root of the number of features, Poisson counts, and leaves of one parent that
predict the same class are merged; only the random numbers are others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.scale import broadcast_if_small, running_totals
from cellweave.session import scratch_path, stored

#: Thresholds of a feature, as Spark ML's 32 bins have them.
THRESHOLDS = 31
#: Rows of a sample whose trees grow by ordered rows.
ORDERED_ROWS = 30_000
#: Rows of a tree's level that are split at once; few enough to stay near the processor.
BATCH_ROWS = 1 << 17
#: Nodes of a forest that is gathered and broadcast to score, 14 bytes each; a larger one stays in the shared folder.
TREE_NODES = 2_500_000
#: Distinct rows, as bytes of thresholds, that such a forest scores in one reading of its trees.
KEYS_SENT = 4_000_000
#: Scores that are added up at once.
KEY_BLOCK = 1 << 16

_TREE = "tree long, feature binary, value binary, child binary, importance array<double>, forest long"


def known_rows(rows: DataFrame, features: Sequence[str], weight: str) -> DataFrame:
    """`_x0, _x1, ..., _y, _w` of the rows whose features are all known."""
    x = [f"_x{i}" for i in range(len(features))]
    named = [F.col(f).cast("double").alias(a) for f, a in zip(features, x, strict=True)]
    return rows.select(*named, F.col("label").cast("double").alias("_y"), F.col(weight).cast("double").alias("_w")).dropna(subset=x)


@dataclass(frozen=True)
class Sample:
    """A fit's rows on the driver, in an order that does not depend on how they were read."""

    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, features: Sequence[str], weight: str, limit: int) -> Sample | None:
        """The rows whose features are all known; None when they are more than `limit`, or are no two-class sample."""
        table = known_rows(rows, features, weight).limit(limit + 1).toArrow()
        data = np.array([c.to_numpy(zero_copy_only=False) for c in table.columns], dtype=float).T
        y, w = data[:, -2], data[:, -1]
        if not 0 < len(data) <= limit or not np.isin(y, (0, 1)).all() or not (np.isfinite(w) & (w >= 0)).all() or not w.any():
            return None
        data = data[np.lexsort(data.T)]
        return cls(data[:, :-2].copy(), data[:, -2].copy(), data[:, -1].copy())

    def binned(self) -> Binned:
        cuts = tuple(thresholds(column, self.weight) for column in self.x.T)
        columns = [np.searchsorted(cut, column) for cut, column in zip(cuts, self.x.T, strict=True)]
        return Binned(cuts, np.array(columns, np.uint8), self.y.astype(np.uint8), self.weight)


@dataclass(frozen=True)
class Binned:
    """A fit's rows as the number of thresholds that each feature lies above. A row may stand for `count` equal ones."""

    cuts: tuple[np.ndarray, ...]
    columns: np.ndarray  # uint8, a line for each feature
    y: np.ndarray  # uint8
    weight: np.ndarray
    count: np.ndarray | None = None  # int32

    @cached_property
    def class_weights(self) -> tuple[float, float] | None:
        """What every row of the positive class and every other row weighs, where that is one number each."""
        own = [self.weight[self.y == c] for c in (1, 0)]
        return tuple(float(w[0]) if len(w) else 1.0 for w in own) if all((w[1:] == w[:-1]).all() for w in own) else None

    @classmethod
    def of(cls, rows: DataFrame, features: Sequence[str], weight: str, limit: int) -> tuple[tuple[np.ndarray, ...], Binned | None] | None:
        """Thresholds of a large table, and its rows unless more than `limit` differ; None when it is no two-class sample.

        Thresholds are told from all rows and equal rows are counted by Spark; only rows that differ reach the driver.
        """
        known, d = stored(known_rows(rows, features, weight), "fitted"), len(features)
        fair = F.col("_y").isin(0.0, 1.0) & (F.col("_w") >= 0) & (F.col("_w") < math.inf)
        checked = known.agg(F.bool_and(F.coalesce(fair, F.lit(False))).alias("fair"), F.max("_w").alias("most")).first()
        if not checked["fair"] or not checked["most"]:
            return None
        cuts = table_thresholds(known, d)
        keyed = known.select(row_key(cuts, [f"_x{i}" for i in range(d)]).alias("_key"), "_y", "_w")
        counted = stored(keyed.groupBy("_key", "_y", "_w").agg(F.count("*").alias("_n")), "counted")
        if counted.count() > limit:
            return cuts, None
        table = counted.select("_key", F.col("_y").cast("tinyint"), "_w", F.col("_n").cast("int")).toArrow()
        y, w, n = (table[c].to_numpy().astype(t) for c, t in (("_y", np.uint8), ("_w", float), ("_n", np.int32)))
        return cuts, cls(cuts, _columns(table["_key"], d), y, w, n).merged()

    def merged(self) -> Binned:
        """Equal rows as one, in an order of its own. A Poisson draw of mean n is the sum of n draws of mean 1, so that trees grow alike."""
        order = np.lexsort((self.weight, self.y, *self.columns))
        columns, y, weight = self.columns[:, order], self.y[order], self.weight[order]
        changes = (columns[:, 1:] != columns[:, :-1]).any(axis=0) | (y[1:] != y[:-1]) | (weight[1:] != weight[:-1])
        first = np.flatnonzero(np.append(True, changes))
        count = np.add.reduceat(np.ones(len(order), np.int32) if self.count is None else self.count[order], first)
        return Binned(self.cuts, columns[:, first], y[first], weight[first], count)


def thresholds(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Where a feature may be cut: between all of its values when they are few, else next to its weighted quantiles."""
    values, place = np.unique(x, return_inverse=True)
    between = values[:-1] / 2 + values[1:] / 2
    if len(between) > THRESHOLDS:
        upto = np.cumsum(np.bincount(place, weight))
        targets = upto[-1] * np.arange(1, THRESHOLDS + 1) / (THRESHOLDS + 1)
        after = np.searchsorted(upto, targets)
        nearer = (after > 0) & (targets - upto[after - 1] < upto[after] - targets)
        between = between[np.unique(np.minimum(after - nearer, len(between) - 1))]
    return between


def table_thresholds(rows: DataFrame, d: int) -> tuple[np.ndarray, ...]:
    """`thresholds` of the columns `_x0, _x1, ...` weighted by `_w`: from all rows, whose values stay distributed.

    Running weights over the distinct values tell in which of the equal shares of the weight a value ends; the first and the last
    value of every share are what the thresholds lie next to. Another pass finds the value that follows each of them.
    """
    long = rows.select("_w", F.posexplode(F.array(*[F.col(f"_x{i}") for i in range(d)])).alias("_f", "_v"))
    counted = long.groupBy("_f", "_v").agg(F.sum("_w").alias("_w"))
    sizes = {r["_f"]: (r["n"], r["total"]) for r in counted.groupBy("_f").agg(F.count("*").alias("n"), F.sum("_w").alias("total")).collect()}
    few = [f for f in sizes if sizes[f][0] <= THRESHOLDS + 1]
    many = [f for f in sizes if f not in few]
    cuts = [np.zeros(0)] * d
    values: dict[int, list[float]] = {}
    for r in counted.where(F.col("_f").isin(few)).collect() if few else ():  # no more than thresholds
        values.setdefault(r["_f"], []).append(r["_v"])
    for f, own in values.items():
        own = np.sort(own)
        cuts[f] = own[:-1] / 2 + own[1:] / 2
    if not many:
        return tuple(cuts)

    upto = running_totals(counted.where(F.col("_f").isin(many)), "_v", ["_w"], ["_f"], at_most=max(sizes[f][0] for f in many))
    total = F.element_at(F.array(*[F.lit(sizes[f][1] if f in sizes else 0.0) for f in range(d)]), F.col("_f") + 1)
    share = F.floor(F.col("cum__w") * (THRESHOLDS + 1) / total).alias("_k")
    found = upto.groupBy("_f", share).agg(*[a("_v").alias(f"{n}v") for n, a in (("first", F.min), ("last", F.max))], F.min("cum__w").alias("firstw"), F.max("cum__w").alias("lastw"))
    shares: dict[int, list] = {f: [] for f in many}
    for r in found.orderBy("_f", "_k").collect():  # one row a feature and share
        shares[r["_f"]].append(r)
    edges = [np.zeros(0)] * d
    for f, own in shares.items():
        at = np.array([r["_k"] for r in own])
        chosen = []
        for k in range(1, THRESHOLDS + 1):
            target = sizes[f][1] * k / (THRESHOLDS + 1)
            i = min(int(np.searchsorted(at, k)), len(own) - 1)
            nearer = i > 0 and (target - own[i - 1]["lastw"] < own[i]["firstw"] - target or own[i]["firstv"] == own[-1]["lastv"])
            chosen.append(own[i - 1]["lastv"] if nearer else own[i]["firstv"])
        edges[f] = np.unique(chosen)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [np.full(len(e) + 1, np.inf) for e in edges]
        for batch in batches:
            for f in many:
                x = batch.column(f).to_numpy(zero_copy_only=False)
                np.minimum.at(least[f], np.searchsorted(edges[f], x), x)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(least).tolist()], pa.list_(pa.float64()))], names=["least"])

    rows_above = rows.select(*[f"_x{i}" for i in range(d)]).mapInArrow(above, "least array<double>")
    least = np.min([r["least"] for r in rows_above.collect()], axis=0)  # a row of a few numbers a task
    for f, own in enumerate(np.split(least, np.cumsum([len(e) + 1 for e in edges])[:-1])):
        if f in shares:
            below, after = edges[f][np.isfinite(own[1:])], own[1:][np.isfinite(own[1:])]
            cuts[f] = below / 2 + after / 2
    return tuple(cuts)


def _codes(cuts: Sequence[np.ndarray], x: pd.DataFrame) -> np.ndarray:
    """Rows of bytes: the number of thresholds that each feature lies above."""
    return np.column_stack([np.searchsorted(cut, x.iloc[:, i].to_numpy(dtype=float)) for i, cut in enumerate(cuts)]).astype(np.uint8)


def _features(features: Sequence[str]) -> Column:
    return F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])


def row_key(cuts: Sequence[np.ndarray], features: Sequence[str]) -> Column:
    """A byte for each feature, all of them known: the number of thresholds that it lies above."""

    @F.pandas_udf("binary")
    def key(x: pd.DataFrame) -> pd.Series:
        raw, d = _codes(cuts, x).tobytes(), len(cuts)
        return pd.Series([raw[i : i + d] for i in range(0, len(raw), d)], dtype=object)

    return key(_features(features))


def row_codes(cuts: Sequence[np.ndarray], features: Sequence[str]) -> Column:
    """The same as an array of numbers."""

    @F.pandas_udf("array<double>")
    def codes(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(_codes(cuts, x).astype(float)))

    return codes(_features(features))


def _columns(keys: pa.ChunkedArray, d: int) -> np.ndarray:
    """Keys of rows as one line for each feature."""
    fixed = [chunk.cast(pa.binary(d)) for chunk in keys.chunks if len(chunk)]
    raw = [np.frombuffer(chunk.buffers()[1], np.uint8)[chunk.offset * d : (chunk.offset + len(chunk)) * d] for chunk in fixed]
    return np.concatenate([np.zeros(0, np.uint8), *raw]).reshape(-1, d).T.copy()


def _pruned(feature: np.ndarray, value: np.ndarray, child: np.ndarray, share: np.ndarray, gain: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree without splits whose sides predict one class, and the gains of the others by feature."""
    leaf, positive = feature < 0, share > 0.5
    while True:
        merge = ~leaf & leaf[child] & leaf[np.minimum(child + 1, len(child) - 1)] & (positive[child] == positive[np.minimum(child + 1, len(child) - 1)])
        if not merge.any():
            break
        leaf |= merge
    kept = np.zeros(len(feature), bool)
    front = np.zeros(1, np.int64)
    while len(front):
        kept[front] = True
        front = child[front[~leaf[front]]]
        front = np.concatenate([front, front + 1])
    place = (np.cumsum(kept) - 1).astype(np.int32)
    gains = np.bincount(feature[kept & ~leaf], gain[kept & ~leaf], d)
    return np.where(leaf, -1, feature)[kept].astype(np.int16), np.where(leaf, share, value)[kept], place[np.where(leaf, np.arange(len(leaf)), child)[kept]], gains


def _best(x: np.ndarray, sums: np.ndarray, sizes: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ordered by node and value: each node's least impurity (weighted, of both sides) and the last row on its left."""
    start, segment = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    running = np.cumsum(sums, axis=1)
    before = running[:, start] - sums[:, start]
    drawn = running[2] - before[2][segment]
    fits = (drawn >= least) & (total[2][segment] - drawn >= least)
    fits[:-1] &= (x[1:] > x[:-1]) & (segment[1:] == segment[:-1])
    fits[-1] = False
    places = np.flatnonzero(fits)
    node = segment[places]
    p, w = running[0][places] - before[0][node], running[1][places] - before[1][node]
    q, v = total[0][node] - p, total[1][node] - w
    cost = np.full(len(x), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        cost[places] = np.where(w > 0, p * (w - p) / w, 0.0) + np.where(v > 0, q * (v - q) / v, 0.0)
    best = np.minimum.reduceat(cost, start)
    ties = np.flatnonzero(cost == best[segment])  # where nothing fits, all rows of a node
    own = segment[ties]
    return best, ties[np.append(True, own[1:] != own[:-1])]


def _grow_ordered(sample: Sample, seed: Sequence[int], depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`grow` by rows kept in order of each feature within their nodes, for small samples."""
    cuts = [thresholds(column, sample.weight) for column in sample.x.T]
    random = np.random.default_rng(seed)
    drawn = random.poisson(1.0, len(sample.y)).astype(float)
    if not drawn.any():
        drawn[random.integers(len(drawn))] = 1.0
    rows = np.flatnonzero(drawn)
    d = sample.x.shape[1]
    looks = int(np.ceil(np.sqrt(d)))
    sums = np.array([drawn * sample.weight * sample.y, drawn * sample.weight, drawn])
    feature, value, child, share, gain = [], [], [], [], []
    columns = np.array([np.searchsorted(cut, column) for cut, column in zip(cuts, sample.x.T, strict=True)], np.uint8)
    orders = [rows[np.argsort(column[rows], kind="stable")] for column in columns]
    sizes, begun = np.array([len(rows)]), 0
    for level in range(depth + 1):
        nodes = len(sizes)
        if not nodes:
            break
        start, segment = np.cumsum(sizes) - sizes, np.repeat(np.arange(nodes), sizes)
        total = np.add.reduceat(sums.take(orders[0], axis=1), start, axis=1)
        own = total[0] * (total[1] - total[0]) / np.where(total[1] > 0, total[1], 1)
        split, cut, at = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), own * (1 - 1e-12)
        may = (total[2] >= 2 * least) & (own > 0) & (level < depth)
        looked = np.argsort(random.random((nodes, d)), axis=1)[:, :looks]
        for f in range(d):
            asked = np.flatnonzero(may & (looked == f).any(axis=1))
            if not len(asked):
                continue
            is_asked = np.zeros(nodes, bool)
            is_asked[asked] = True
            order = orders[f][is_asked[segment]]
            x = columns[f][order]
            best, last = _best(x, sums.take(order, axis=1), sizes[asked], total[:, asked], least)
            better = best < at[asked]
            mine, last = asked[better], last[better]
            split[mine], at[mine], cut[mine] = f, best[better], x[last]
        inner = split >= 0
        gain.append(np.where(inner, own - at, 0.0))
        feature.append(split)
        value.append(np.array([cuts[f][c] if f >= 0 else 0.0 for f, c in zip(split.tolist(), cut.tolist(), strict=True)]))
        share.append(total[0] / np.where(total[1] > 0, total[1], 1))
        child.append(np.where(inner, begun + nodes + 2 * (np.cumsum(inner) - 1), begun + np.arange(nodes)).astype(np.int32))
        begun += nodes
        # Rows of split nodes stay, in order, the left side of a node before its right side.
        stays = inner[segment]
        below = np.zeros(len(sample.y), np.uint16 if nodes < 1 << 15 else np.int64)  # numpy sorts short numbers by their digits
        below[orders[0]] = 2 * (np.cumsum(inner) - 1)[segment] + (columns[np.maximum(split, 0)[segment], orders[0]] > cut[segment])
        orders = [order[stays] for order in orders]
        sizes = np.bincount(below[orders[0]], minlength=2 * int(inner.sum()))
        orders = [order[np.argsort(below[order], kind="stable")] for order in orders]
    return _pruned(*[np.concatenate(c) for c in (feature, value, child, share, gain)], d)


class _Drawn:
    """The drawn rows of a tree, and sums over them: of the positive class, of the other, and draws.

    Where all rows of a class weigh the same, which they mostly do, `columns` hold the class in their last bit, and one
    count by class gives all three sums; times `scale` they are weights.
    """

    def __init__(self, rows: Binned, drawn: np.ndarray):
        self.classes, self.scale = (1, (1.0, 1.0)) if rows.class_weights is None else (2, rows.class_weights)
        kept = np.flatnonzero(drawn)
        y, drawn, self.columns = rows.y[kept], drawn[kept], rows.columns[:, kept]
        if self.classes == 2:
            self.columns = 2 * self.columns + y
            self.own = (drawn.astype(np.float32),)
        else:
            self.own = (drawn * rows.weight[kept] * y, drawn * rows.weight[kept] * (1 - y), drawn)

    def sums(self, own: Sequence[np.ndarray], group: np.ndarray, column: np.ndarray, width: int, groups: int) -> list[np.ndarray]:
        """By group and the `width` values of a column, in one line."""
        size = self.classes * groups * width
        tables: list = [0.0] * len(own)
        for lo in range(0, len(group), BATCH_ROWS):
            here = slice(lo, lo + BATCH_ROWS)
            key = group[here] * np.int32(self.classes * width) + (column[here] if column.ndim else column)
            found = [np.bincount(key, o[here], size) for o in own]
            tables = [t + f for t, f in zip(tables, found, strict=True)] if lo else found
        if self.classes == 1:
            return tables
        positive, other = tables[0][1::2], tables[0][::2]
        return [positive, other, positive + other]

    def impurity(self, positive: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Gini impurity times the weight, halved."""
        p, q = positive * self.scale[0], other * self.scale[1]
        return p * q / np.maximum(p + q, 1e-300)


def grow(sample: Sample | Binned, seed: Sequence[int], depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as feature (-1: a leaf), value (threshold, or a leaf's share of the positive class) and left child of each
    node, whose right child follows it; and the gain of each feature.

    Rows count as often as a Poisson draw says. A node looks at the root of the number of features, rounded up; both sides
    of a split hold `least` drawn rows and lower the weighted Gini impurity. All nodes of a batch are split together, each
    feature by one table of nodes and thresholds; a level of many rows goes on in several batches. Samples of up to ORDERED_ROWS
    rows have their rows ordered instead: other sums, so other choices between splits that are equally good.
    """
    if isinstance(sample, Sample) and len(sample.y) <= ORDERED_ROWS:
        return _grow_ordered(sample, seed, depth, least)
    binned = sample.binned() if isinstance(sample, Sample) else sample
    cuts, d = binned.cuts, len(binned.columns)
    random = np.random.default_rng(seed)
    drawn = random.poisson(1.0 if binned.count is None else binned.count, len(binned.y))
    if not drawn.any():
        drawn[random.integers(len(drawn))] = 1
    rows = _Drawn(binned, drawn)
    looks = int(np.ceil(np.sqrt(d)))
    made, begun = [], 1
    batches = [(0, np.zeros(1, np.int32), np.zeros(len(rows.own[0]), np.int32), rows.columns, rows.own)]
    while batches:
        level, ids, node, columns, own = batches.pop()  # rows whose node is len(ids) ended above
        total = [t[: len(ids)] for t in rows.sums(own, node, columns[0] & 1 if rows.classes == 2 else np.array(0, np.int32), 1, len(ids) + 1)]
        impure = rows.impurity(*total[:2])
        positive, other = total[0] * rows.scale[0], total[1] * rows.scale[1]
        share = positive / np.maximum(positive + other, 1e-300)
        feature, value, child, gain = np.full(len(ids), -1, np.int16), np.zeros(len(ids)), ids.copy(), np.zeros(len(ids))
        made.append((ids, feature, value, child, share, gain))
        may = (total[2] >= 2 * least) & (impure > 0) & (level < depth)
        open_ = np.flatnonzero(may)
        if not len(open_):
            continue
        stays = np.flatnonzero(np.append(may, False)[node])
        if len(stays) < len(node):
            node = (np.cumsum(may, dtype=np.int32) - 1)[node[stays]]
            columns, own = columns.take(stays, axis=1), tuple(o[stays] for o in own)
        total, at = [t[open_] for t in total], impure[open_]
        split, cut, lowest = np.full(len(open_), -1, np.int16), np.zeros(len(open_), np.uint8), at * (1 - 1e-12)
        looked = np.argsort(random.random((len(open_), d)), axis=1)[:, :looks]
        for f in range(d):
            asked, width = np.flatnonzero((looked == f).any(axis=1)), len(cuts[f]) + 1
            if not len(asked) or width == 1:
                continue
            tables = rows.sums(own, node, columns[f], width, len(open_))
            left = [np.cumsum(t.reshape(-1, width)[asked, :-1], axis=1) for t in tables]
            right = [t[asked, None] - below for t, below in zip(total, left, strict=True)]
            cost = rows.impurity(*left[:2]) + rows.impurity(*right[:2])
            cost[(left[2] < least) | (right[2] < least)] = np.inf
            best = cost.argmin(axis=1)
            cost = cost[np.arange(len(asked)), best]
            better = cost < lowest[asked]
            mine = asked[better]
            split[mine], cut[mine], lowest[mine] = f, best[better], cost[better]
        inner = np.flatnonzero(split >= 0)
        if not len(inner):
            continue
        mine = open_[inner]
        feature[mine], gain[mine] = split[inner], at[inner] - lowest[inner]
        value[mine] = [cuts[f][c] for f, c in zip(split[inner].tolist(), cut[inner].tolist(), strict=True)]
        child[mine] = begun + 2 * np.arange(len(inner))
        ids = begun + np.arange(2 * len(inner), dtype=np.int32)
        begun += len(ids)
        above = columns[np.maximum(split, 0)[node], np.arange(len(node))] >= (rows.classes * (cut + np.uint8(1)))[node]
        below = np.full(len(open_), len(ids), np.int32)
        below[inner] = 2 * np.arange(len(inner))
        node = below[node] + (above & (split >= 0)[node])
        if len(node) <= BATCH_ROWS or len(ids) == 2:
            batches.append((level + 1, ids, node, columns, own))
            continue
        order = np.argsort(node.astype(np.uint16) if len(ids) < 1 << 16 else node, kind="stable")  # numpy sorts short numbers by their digits
        upto = np.cumsum(np.bincount(node, minlength=len(ids))[: len(ids)])
        part = upto // BATCH_ROWS
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for lo, hi in zip(first, np.append(first[1:], len(ids)), strict=True):
            mine = order[(upto[lo - 1] if lo else 0) : upto[hi - 1]]
            batches.append((level + 1, ids[lo:hi], node[mine] - np.int32(lo), columns[:, mine], tuple(o[mine] for o in own)))
    ids, *parts = (np.concatenate(c) for c in zip(*made, strict=True))
    order = np.argsort(ids)
    feature, value, child, share, gain = (c[order] for c in parts)
    return _pruned(feature, value, child, share, gain, d)


def _summed(trees: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Sum of the shares of the positive class over all trees."""
    total = np.zeros(len(x))
    for feature, value, child in trees:
        node, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(open_):
            here = node[open_]
            own = feature[here]
            inner = own >= 0
            open_, here, own = open_[inner], here[inner], own[inner]
            node[open_] = child[here] + (x[open_, own] > value[here])
        total += value[node]
    return total


def probability(trees: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Mean share of the positive class over all trees."""
    return _summed(trees, x) / len(trees)


def _tree(feature: bytes, value: bytes, child: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(feature, np.int16), np.frombuffer(value, float), np.frombuffer(child, np.int32)


@dataclass(frozen=True)
class Part:
    """Some trees of a grown forest, as far as importances and counts go."""

    getNumTrees: int
    featureImportances: DenseVector


@dataclass(frozen=True)
class Grown:
    """The trees of one forest in the shared folder."""

    table: DataFrame
    forest: int
    size: int
    nodes: int
    cuts: tuple[np.ndarray, ...]
    certain: bool  # no row of the positive class: what is scored is the probability of the only one

    @property
    def _own(self) -> DataFrame:
        return self.table.where(F.col("forest") == self.forest)

    @cached_property
    def _trees(self):
        rows = self._own.orderBy("tree").select("feature", "value", "child").collect()
        return self.table.sparkSession.sparkContext.broadcast([_tree(*r) for r in rows])

    def score(self, cells: DataFrame, features: Sequence[str], name: str) -> DataFrame:
        """Add the probability to rows whose features are all known.

        A small forest goes to the rows. Of a large one, every task that reads some trees scores all rows that differ in a threshold by
        them, the scores of all trees are added up, and rows meet theirs by their key.
        """
        if self.certain:
            return cells.withColumn(name, F.lit(1.0))
        if self.nodes > TREE_NODES:
            keyed = cells.withColumn("_key", row_key(self.cuts, features))
            return keyed.join(broadcast_if_small(self._key_scores(keyed, name)), "_key").select(*[c for c in cells.columns if c != name], name)
        trees = self._trees

        @F.pandas_udf("double")
        def scored(x: pd.DataFrame) -> pd.Series:
            return pd.Series(probability(trees.value, x.to_numpy(dtype=float)))

        return cells.withColumn(name, scored(_features(features)))

    def _key_scores(self, keyed: DataFrame, name: str) -> DataFrame:
        """`_key` and its score."""
        distinct = stored(keyed.select("_key").distinct(), "keys")
        rounds = max(1, math.ceil(distinct.count() / KEYS_SENT))
        round_of = F.pmod(F.xxhash64("_key"), F.lit(rounds))
        return reduce(DataFrame.unionByName, [self._scores_of(distinct.where(round_of == k), name) for k in range(rounds)])

    def _scores_of(self, keys: DataFrame, name: str) -> DataFrame:
        """The scores of so many keys that all tasks can hold them, as a stored table."""
        d, size = len(self.cuts), self.size
        columns = _columns(keys.toArrow()["_key"], d)
        sent = keys.sparkSession.sparkContext.broadcast(columns[:, np.lexsort(columns)])
        points = [np.append(cut, np.inf) for cut in self.cuts]  # a value of each feature for each number of thresholds below it

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns, first = sent.value, None
            total = np.zeros(columns.shape[1])
            for batch in batches:
                if not batch.num_rows:
                    continue
                first = batch.column("tree")[0].as_py() if first is None else first
                trees = [_tree(*[batch.column(c)[i].as_buffer() for c in ("feature", "value", "child")]) for i in range(batch.num_rows)]
                for lo in range(0, len(total), KEY_BLOCK):
                    part = columns[:, lo : lo + KEY_BLOCK]
                    total[lo : lo + KEY_BLOCK] += _summed(trees, np.column_stack([p[c] for p, c in zip(points, part, strict=True)]))
            for lo in range(0, 0 if first is None else len(total), KEY_BLOCK):
                row = [pa.array([lo]), pa.array([first]), pa.array([total[lo : lo + KEY_BLOCK].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["start", "first", "sums"])

        def added(parts: pa.Table) -> pa.Table:
            parts = parts.sort_by("first")  # sums do not depend on which task came first
            lo, total = parts["start"][0].as_py(), sum(np.frombuffer(b, float) for b in parts["sums"].to_pylist())
            raw = sent.value[:, lo : lo + len(total)].T.tobytes()
            return pa.table({"_key": pa.array([raw[i : i + d] for i in range(0, len(raw), d)], pa.binary()), name: total / size})

        parts = self._own.select("tree", "feature", "value", "child").mapInArrow(scored, "start long, first long, sums binary")
        return stored(parts.groupBy("start").applyInArrow(added, f"_key binary, `{name}` double"), "scores")


def grow_forests(spark: SparkSession, samples: Sequence[Sample | Binned], sizes: Sequence[int], depth: int, least: int, seed: int) -> list[tuple[Grown, tuple[Part, ...]]]:
    """A forest of sum(sizes) trees on each sample, in parts of `sizes` trees; all trees are dealt over the tasks."""
    sent = spark.sparkContext.broadcast([tuple(getattr(s, f.name) for f in fields(s)) for s in samples])
    each, many = sum(sizes), len(samples)

    def growing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                tree, forest = divmod(i, many)  # a task grows trees of all forests
                given = sent.value[forest]
                feature, value, child, gain = grow(Sample(*given) if len(given) == 3 else Binned(*given), [seed, forest, tree], depth, least)
                row = [[tree], [feature.tobytes()], [value.tobytes()], [child.tobytes()], [(gain / (gain.sum() or 1.0)).tolist()], [forest]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=names)

    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.int64()]
    names = ["tree", "feature", "value", "child", "importance", "forest"]
    total = each * many
    tasks = min(total, 4 * spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, "trees")
    spark.range(0, total, 1, tasks).mapInArrow(growing, _TREE).write.partitionBy("forest").parquet(path)
    table = spark.read.schema(_TREE).parquet(path)
    cuts = [s.binned().cuts if isinstance(s, Sample) else s.cuts for s in samples]
    gains, nodes = np.zeros((many, each, len(cuts[0]))), np.zeros(many, int)
    for r in table.select("forest", "tree", "importance", F.length("feature").alias("bytes")).collect():  # a few numbers a tree
        gains[r["forest"], r["tree"]] = r["importance"]
        nodes[r["forest"]] += r["bytes"] // 2
    forests = []
    for k, sample in enumerate(samples):
        ends = np.cumsum(sizes)
        sums = [gains[k, end - size : end].sum(axis=0) for size, end in zip(sizes, ends, strict=True)]
        parts = tuple(Part(size, Vectors.dense(s / (s.sum() or 1.0))) for size, s in zip(sizes, sums, strict=True))
        forests.append((Grown(table, k, each, int(nodes[k]), cuts[k], not sample.y.any()), parts))
    return forests
