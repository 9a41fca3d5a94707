"""Approximate nearest neighbours by an inverted multi-index: both vector halves are quantised on their own."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm.common import column_of
from cellweave.llm.vectors import cosines, distances, k_means, matrix, sample, unit, usable
from cellweave.session import stored

SHARD = 2048  # entries that one task holds at a time


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of both halves, entries of every cell, and the shard that holds each cell."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # (left, right)
    shard: np.ndarray  # cells in order; neighbouring small cells share a shard
    blocks: np.ndarray  # by shard: pieces that its entries are dealt into

    def cells(self, u: np.ndarray) -> np.ndarray:
        half = self.left.shape[1]
        a = distances(u[:, :half], self.left).argmin(axis=1)
        return a * len(self.right) + distances(u[:, half:], self.right).argmin(axis=1)

    def order(self, u: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells that hold vectors, and how many, by the summed distance of their two centroids.

        The heap holds one next pair for every left centroid in use.
        """
        half = self.left.shape[1]
        dl, dr = distances(u[None, :half], self.left)[0], distances(u[None, half:], self.right)[0]
        by_l, by_r = np.argsort(dl, kind="stable").tolist(), np.argsort(dr, kind="stable").tolist()
        dl, dr, counts, m = dl.tolist(), dr.tolist(), self.counts, len(by_r)
        heap = [(dl[by_l[0]] + dr[by_r[0]], 0, 0)]
        while heap:
            _, i, j = heap[0]
            if j + 1 < m:
                heapq.heapreplace(heap, (dl[by_l[i]] + dr[by_r[j + 1]], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(by_l):
                heapq.heappush(heap, (dl[by_l[i + 1]] + dr[by_r[0]], i + 1, 0))
            here = counts[by_l[i], by_r[j]]
            if here:
                yield by_l[i] * m + by_r[j], int(here)

    def visit(self, u: np.ndarray, entries: int) -> list[int]:
        """The first cells in this order that together hold `entries` vectors, or all."""
        out, held = [], 0
        for cell, here in self.order(u):
            out.append(cell)
            held += here
            if held >= entries:
                break
        return out

    def needed(self, u: np.ndarray, cells: set[int]) -> list[int]:
        """Entries that must be visited to reach each of these cells."""
        out, held = [], 0
        for cell, here in self.order(u):
            held += here
            if cell in cells:
                out.append(held)
                if len(out) == len(cells):
                    break
        return out


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each cell and blocks of each shard: neighbouring cells fill a shard, a large cell is split."""
    shard, sizes = np.zeros(counts.size, dtype=np.int32), [0]
    for cell, n in enumerate(counts.ravel().tolist()):
        if sizes[-1] and sizes[-1] + n > SHARD:
            sizes.append(0)
        shard[cell] = len(sizes) - 1
        sizes[-1] += n
    return shard, np.maximum(1, -(-np.array(sizes) // SHARD))


def _assign(batches: Iterator[pa.RecordBatch], left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    index = MultiIndex(left, right, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    for batch in batches:
        cell = index.cells(unit(matrix(batch))) if batch.num_rows else np.zeros(0, dtype=np.int64)
        names = ["k1", "k2", "e", "ids"]
        yield pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in names], pa.array(cell.astype(np.int32))], [*names, "cell"])


def _route(batches: Iterator[pa.RecordBatch], index: MultiIndex, entries: int) -> Iterator[pa.RecordBatch]:
    """Send every query to the blocks of the shards that hold its cells, with the cells to look at there."""
    for batch in batches:
        rows, shards, blocks, cells = [], [], [], []
        for row, u in enumerate(unit(matrix(batch))) if batch.num_rows else ():
            by: dict[int, list[int]] = {}
            for c in index.visit(u, entries):
                by.setdefault(int(index.shard[c]), []).append(c)
            for s, some in by.items():
                for b in range(int(index.blocks[s])):
                    rows.append(row)
                    shards.append(s)
                    blocks.append(b)
                    cells.append(sorted(some))
        taken = [column_of(batch, c).take(pa.array(rows, pa.int64())) for c in ("k1", "k2", "e")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int32()), pa.array(blocks, pa.int32()), *taken, pa.array(cells, pa.list_(pa.int32()))],
            ["shard", "block", "k1", "k2", "e", "cells"],
        )


def _search(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Best `top` entries of each query in each block, by exact cosine.

    Rows come by block, entries (kind 0) before queries, so a task holds one block and a batch of queries.
    """
    at, held, entries = None, [], None
    for batch in batches:
        shard, block, kind = (column_of(batch, c).to_numpy() for c in ("shard", "block", "kind"))
        out: list[list] = [[], [], [], []]
        edges = np.flatnonzero((shard[1:] != shard[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if (shard[a], block[a]) != at:
                at, held, entries = (shard[a], block[a]), [], None
            if kind[a] == 0:
                held.append(part)
                entries = None
            elif held:
                if entries is None:
                    table = pa.Table.from_batches(held)
                    x = matrix(table)
                    entries = (x, unit(x), table["cell"].to_numpy(), table["ids"].to_pylist())
                _rank(part, entries, top, out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())],
            ["k1", "k2", "vec_id", "score"],
        )


def _rank(queries: pa.RecordBatch, entries: tuple, top: int, out: list[list]) -> None:
    x, u, cell, ids = entries
    q = matrix(queries)
    near = unit(q) @ u.T
    k1, k2 = (column_of(queries, c).to_pylist() for c in ("k1", "k2"))
    listed = column_of(queries, "cells")
    visited, ends = listed.flatten().to_numpy(), np.cumsum(listed.value_lengths().to_numpy())
    wanted = np.zeros(max(cell.max(), visited.max(initial=0)) + 1, dtype=bool)
    for row in range(len(q)):
        mine = visited[(ends[row - 1] if row else 0) : ends[row]]
        wanted[mine] = True
        some = np.flatnonzero(wanted[cell])
        wanted[mine] = False
        if not len(some):
            continue
        value = near[row, some]
        if len(some) > top:
            some = some[value >= np.partition(value, -top)[-top] - 1e-9]  # ties and rounding stay in
        exact = cosines(np.broadcast_to(q[row], (len(some), q.shape[1])), x[some])
        best = sorted((-s, v) for s, e in zip(exact.tolist(), some.tolist(), strict=True) for v in ids[e])[:top]
        out[0] += [k1[row]] * len(best)
        out[1] += [k2[row]] * len(best)
        out[2] += [v for _, v in best]
        out[3] += [-s for s, _ in best]


def _nearest_cells(batches: Iterator[pa.RecordBatch], asked: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """Of each batch, the cells of the `top` nearest entries of every asked vector, with their cosines."""
    for batch in batches:
        if not batch.num_rows:
            continue
        near = asked @ unit(matrix(batch)).T
        best = np.argsort(-near, axis=1, kind="stable")[:, :top]
        row = np.repeat(np.arange(len(asked)), best.shape[1])
        cell = column_of(batch, "cell").to_numpy()[best.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(cell), pa.array(near[row, best.ravel()])], ["row", "cell", "near"])


def enough_entries(index: MultiIndex, once: DataFrame, asked: np.ndarray, top: int, recall: float) -> int:
    """Entries that a query must visit so that `recall` of the `top` nearest are among them.

    Brute force over all entries for the few vectors `asked`: for each of their true neighbours, how many
    entries come before its cell is done; the quantile over all of them.
    """
    if not len(asked):
        return 1
    found = once.mapInArrow(lambda b: _nearest_cells(b, asked, top + 1), "row long, cell int, near double")
    best = W.partitionBy("row").orderBy(F.desc("near"), "cell")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).groupBy("row").agg(F.collect_list("cell").alias("cells"))
    needed = sorted(n for r in found.collect() for n in index.needed(asked[r["row"]], set(r["cells"])))
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def nearest(
    vectors: DataFrame, is_query, top: int = 5, recall: float = 0.97, entries: int | None = None, asked_rows: int = 150,
    fit_rows: int = 20_000, cell_rows: float = 3.0, most: int = 512,
) -> DataFrame:
    """The `top` nearest vectors by cosine of every query row: query_id, rank, vec_id, score.

    `is_query` is a condition on vec_id. Candidates are all rows with another vec_id; nearest first, ties to the
    smaller vec_id. Score is the cosine of the original vectors in double precision.

    Inverted multi-index: the halves of the unit vectors are quantised separately (k-means on about
    `fit_rows` vectors chosen by hash; every vector is indexed), so k centroids a half make k * k cells; k
    grows so that a cell holds about `cell_rows` vectors, up to `most` centroids a half (the cells' sizes are
    held in every task). A query visits cells by the sum of its two centroid distances until they hold
    `entries` vectors, and these are reranked exactly. By default brute force for about `asked_rows` of the
    queries tells how many entries give `recall`: few where vectors form clusters, a good part of all where they do
    not. Small neighbouring cells share a shard, large cells are split, so that no cell must fit in a task.

    Equal vectors are one entry with its `top` + 1 smallest ids, which is all that any answer can need, and
    equal queries are searched once. Null, zero, non-finite vectors, vectors with null components or of an odd
    length, and null vec_ids take no part. Repeated rows count once. With fewer candidates than `top` all are
    returned, if the visited cells hold them; an empty table gives no rows. Other columns are ignored.
    """
    rows = stored(usable(vectors).where("vec_id is not null"), "vectors")
    train = sample(rows, fit_rows)
    n = rows.count()
    half = max(1, train.shape[1] // 2)
    k = int(np.clip(round((n / cell_rows) ** 0.5), 1, most))
    left, right = k_means(train[:, :half], k, seed=1), k_means(train[:, half:], k, seed=2)
    ranked = W.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.select("k1", "k2", "vec_id").distinct().withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= top + 1)
    ids = few.groupBy("k1", "k2").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, top + 1).alias("ids"))
    once = rows.groupBy("k1", "k2").agg(F.first("e").alias("e")).join(ids, ["k1", "k2"]).select("k1", "k2", "e", "ids")
    once = stored(once.mapInArrow(lambda b: _assign(b, left, right), "k1 long, k2 long, e array<double>, ids array<long>, cell int"), "cells")
    counts = np.zeros(len(left) * len(right), dtype=np.int64)
    for r in once.groupBy("cell").count().collect():  # at most k * k rows
        counts[r["cell"]] = r["count"]
    shard, blocks = layout(counts)
    index = MultiIndex(left, right, counts.reshape(len(left), len(right)), shard, blocks)

    asked = rows.where(is_query).select("vec_id", "k1", "k2").distinct()
    asked = asked.withColumnsRenamed({"vec_id": "query_id", "k1": "q1", "k2": "q2"})
    queries = once.join(asked, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")), "left_semi")
    if entries is None:
        share = min(1.0, asked_rows / max(queries.count(), 1))
        some = queries.where(F.pmod(F.xxhash64(F.lit(6), "k1"), F.lit(1_000_000)) < int(share * 1_000_000)).select("k1", "k2", "e").toArrow()
        some = some.sort_by([("k1", "ascending"), ("k2", "ascending")])
        entries = enough_entries(index, once, unit(matrix(some)) if some.num_rows else np.zeros((0, 1)), top, recall)
    sent = queries.select("k1", "k2", "e").mapInArrow(lambda b: _route(b, index, entries), "shard int, block int, k1 long, k2 long, e array<double>, cells array<int>")
    sent = sent.selectExpr("shard", "block", "1 as kind", "k1", "k2", "e", "cells", "cast(null as int) as cell", "cast(null as array<long>) as ids")
    pieces = once.mapInArrow(lambda b: _entries(b, index), "shard int, block int, kind int, k1 long, k2 long, e array<double>, cells array<int>, cell int, ids array<long>")
    both = pieces.unionByName(sent).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    found = both.mapInArrow(lambda b: _search(b, top + 1), "k1 long, k2 long, vec_id long, score double")
    order = W.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)
    answers = asked.join(found, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).where("vec_id <> query_id")
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _entries(batches: Iterator[pa.RecordBatch], index: MultiIndex) -> Iterator[pa.RecordBatch]:
    """The shard and block of every entry."""
    for batch in batches:
        n = batch.num_rows
        cell = column_of(batch, "cell").to_numpy()
        shard = index.shard[cell].astype(np.int32)
        block = (column_of(batch, "k2").to_numpy().astype(np.uint64) % index.blocks[shard].astype(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shard),
                pa.array(block),
                pa.array(np.zeros(n, dtype=np.int32)),
                *[column_of(batch, c) for c in ("k1", "k2", "e")],
                pa.nulls(n, pa.list_(pa.int32())),
                column_of(batch, "cell"),
                column_of(batch, "ids"),
            ],
            ["shard", "block", "kind", "k1", "k2", "e", "cells", "cell", "ids"],
        )
