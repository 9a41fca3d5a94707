"""Near-duplicate vectors by product quantisation: inverted lists with residual codes and an exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column_of, components, spread
from cellweave.llm.vectors import cosines, distances, k_means, matrix, sample, unit, usable
from cellweave.session import stored

BLOCK = 1024  # members of a list that one task holds at a time
SLACK = 1e-9  # rounding of distances in double precision
ROUNDING = 1e-4  # and of distances and cosines in single precision; what they let pass is computed in double


@dataclass(frozen=True)
class Codebooks:
    """Centres of the lists, and for each subspace of the residuals its centres."""

    lists: np.ndarray
    books: tuple[np.ndarray, ...]

    @property
    def edges(self) -> np.ndarray:
        return np.cumsum([0, *[b.shape[1] for b in self.books]])

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, distance to the list's centre and distance to the decoded vector of each row."""
        mine = distances(u, self.lists).argmin(axis=1)
        rest = u - self.lists[mine]
        codes = np.empty((len(u), len(self.books)), dtype=np.uint8)
        error = np.zeros(len(u))
        for s, book in enumerate(self.books):
            part = rest[:, self.edges[s] : self.edges[s + 1]]
            codes[:, s] = distances(part, book).argmin(axis=1)
            error += ((part - book[codes[:, s]]) ** 2).sum(axis=1)
        return mine, codes, np.sqrt((rest * rest).sum(axis=1)), np.sqrt(error)

    def tables(self, u: np.ndarray, here: int) -> list[np.ndarray]:
        """Squared distances of each row's residual to every code, by subspace."""
        rest = u - self.lists[here]
        return [distances(rest[:, self.edges[s] : self.edges[s + 1]], book) for s, book in enumerate(self.books)]


def fit_codebooks(train: np.ndarray, lists: int, subspaces: int, codes: int) -> Codebooks:
    centres = k_means(train, lists, seed=3)
    rest = train - centres[distances(train, centres).argmin(axis=1)] if len(train) else train
    edges = np.linspace(0, train.shape[1], min(subspaces, train.shape[1]) + 1).astype(int)
    return Codebooks(centres, tuple(k_means(rest[:, a:b], codes, seed=4 + a) for a, b in zip(edges, edges[1:], strict=False)))


def probes(u: np.ndarray, own: np.ndarray, centres: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Which lists each vector must visit to miss no vector within `reach`: a matrix of booleans.

    A vector y of list c lies nearer to c than to x's own centre, so x is no farther than `reach` from the plane
    between both; and y lies within the list's radius of c.
    """
    d = distances(u, centres)
    gap = np.sqrt(distances(centres, centres))
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d - d[np.arange(len(u)), own][:, None]) / (2 * gap[own])
    plane[gap[own] == 0] = 0
    return (plane <= reach + SLACK) & (np.sqrt(d) <= radius[None, :] + reach + SLACK)


def _encode(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    keep = ["node", "copies", "e"]
    for batch in batches:
        mine, codes, far, error = books.encode(unit(matrix(batch))) if batch.num_rows else (np.zeros(0, int), np.zeros((0, 1), np.uint8), np.zeros(0), np.zeros(0))
        yield pa.RecordBatch.from_arrays(
            [*[column_of(batch, c) for c in keep], pa.array(mine.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(error)],
            [*keep, "list", "codes", "far", "error"],
        )


def _deal(batches: Iterator[pa.RecordBatch], books: Codebooks, blocks: np.ndarray, radius: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """Place every vector in a block of its list, and send it to the blocks that it has to be compared with.

    Each unordered pair meets once: within a block, between blocks of a list from the lower to the higher block,
    between lists from the lower to the higher list.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        own = column_of(batch, "list").to_numpy()
        node = column_of(batch, "node").to_numpy()
        mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        block = (mixed % blocks[own].astype(np.uint64)).astype(np.int64)
        go = probes(unit(matrix(batch)), own, books.lists, radius, reach)
        every = np.arange(batch.num_rows)
        higher = blocks[own] - 1 - block  # blocks of the own list after the own block
        r, c = np.nonzero(go & (np.arange(len(blocks))[None, :] > own[:, None]))
        again = np.repeat(np.arange(len(r)), blocks[c])
        first = np.cumsum(blocks[c]) - blocks[c]
        mine = np.repeat(every, higher)
        step = np.arange(len(mine)) - np.repeat(np.cumsum(higher) - higher, higher)
        rows = np.concatenate([every, mine, r[again]])
        lists = np.concatenate([own, own[mine], c[again]]).astype(np.int32)
        places = np.concatenate([block, block[mine] + 1 + step, np.arange(len(again)) - first[again]]).astype(np.int32)
        kinds = np.concatenate([np.zeros(len(every)), np.ones(len(mine) + len(again))]).astype(np.int32)
        keep = ["node", "copies", "e", "codes", "error"]
        for at in range(0, len(rows), 20_000):
            some = slice(at, at + 20_000)
            taken = [column_of(batch, c).take(pa.array(rows[some])) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists[some]), pa.array(places[some]), pa.array(kinds[some]), *taken], ["list", "block", "kind", *keep]
            )


class _Block:
    """Members of a list that a task holds; single precision where bounds and slack allow for it."""

    def __init__(self, held: list[pa.RecordBatch], reach: float) -> None:
        table = pa.Table.from_batches(held)
        self.node, self.copies = table["node"].to_numpy(), table["copies"].to_numpy()
        self.x = matrix(table)
        self.u = unit(self.x).astype(np.float32)
        self.codes = np.frombuffer(b"".join(table["codes"].to_pylist()), dtype=np.uint8).reshape(len(self.x), -1).T.astype(np.intp)
        # the largest squared coded distance of a vector within reach, by the triangle inequality
        self.limit = ((reach + table["error"].to_numpy() + ROUNDING) ** 2 + ROUNDING).astype(np.float32)


def _linked(books: Codebooks, here: int, x: np.ndarray, u: np.ndarray, block: _Block, threshold: float) -> np.ndarray:
    """Pairs (rows of x, members) of exact cosine >= threshold, among those the coded distances do not rule out."""
    coded = np.zeros((len(x), len(block.node)), dtype=np.float32)
    for table, codes in zip(books.tables(u, here), block.codes, strict=True):
        coded += np.take(table.astype(np.float32), codes, axis=1)
    maybe = coded <= block.limit
    out = np.zeros_like(maybe)
    if not maybe.any():
        return out
    near = u.astype(np.float32) @ block.u.T
    a, b = np.nonzero(maybe & (near >= threshold - ROUNDING))
    for at in range(0, len(a), 4096):
        i, j = a[at : at + 4096], b[at : at + 4096]
        out[i, j] = cosines(x[i], block.x[j]) >= threshold
    return out


def _compare(batches: Iterator[pa.RecordBatch], books: Codebooks, reach: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each block among its members and with its visitors: node, links (copies counted), peer.

    Rows come by block, members (kind 0) before visitors (kind 1), so a task holds one block and a batch. `peer`
    is the smallest node that a node reaches over the links at hand.
    """
    at, held, block = None, [], None
    for batch in batches:
        lists, places, kinds = (column_of(batch, c).to_numpy() for c in ("list", "block", "kind"))
        edges = np.flatnonzero((lists[1:] != lists[:-1]) | (places[1:] != places[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if (lists[a], places[a]) != at:
                if held:
                    yield from _links(books, at[0], None, _Block(held, reach), threshold)
                at, held, block = (lists[a], places[a]), [], None
            rows = batch.slice(a, b - a)
            if kinds[a] == 0:
                held.append(rows)
                continue
            if block is None and held:
                block = _Block(held, reach)
                yield from _links(books, at[0], None, block, threshold)
            held = []
            if block is not None:
                yield from _links(books, at[0], rows, block, threshold)
    if held:
        yield from _links(books, at[0], None, _Block(held, reach), threshold)


def _links(books: Codebooks, here: int, visitors: pa.RecordBatch | None, block: _Block, threshold: float) -> Iterator[pa.RecordBatch]:
    own = visitors is None
    x = block.x if own else matrix(visitors)
    node = block.node if own else column_of(visitors, "node").to_numpy()
    copies = block.copies if own else column_of(visitors, "copies").to_numpy()
    for low in range(0, len(x), 512):
        part = slice(low, low + 512)
        found = _linked(books, here, x[part], unit(x[part]), block, threshold)
        if own:
            found &= np.arange(low, low + len(found))[:, None] < np.arange(len(block.node))[None, :]
        i, j = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
        if not len(i):
            continue
        hit = found[np.ix_(i, j)]
        nodes = np.concatenate([node[part][i], block.node[j]])
        links = np.concatenate([hit @ block.copies[j], copies[part][i] @ hit])
        peer = spread(nodes, np.arange(len(i)), np.arange(len(i), len(nodes)), hit)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(peer, pa.int64())], ["node", "links", "peer"])


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, fit_rows: int = 20_000, list_rows: float = 400.0, most_lists: int = 512, subspaces: int = 8, codes: int = 64
) -> DataFrame:
    """Link vectors whose cosine is at least `threshold`: vec_id, n_links, component_id, kept.

    One row per row of `vectors` (`vec_id`, `embedding`): n_links counts the other rows linked directly, copies
    included, component_id is the smallest vec_id reachable over links and kept says vec_id = component_id.

    Equal vectors are compared once. Unit vectors are put into inverted lists around centres (k-means on about
    `fit_rows` vectors chosen by hash; a list for about `list_rows` vectors, at most `most_lists`), and their
    residuals are coded by `subspaces` codebooks. Each vector visits every list that could hold a vector within
    reach, by bounds that leave out none; there, asymmetric distances from lookup tables, less the known coding
    error, rule out pairs, and the cosine of the original vectors in double precision decides the rest. So no
    link is lost, whatever the codebooks are. Large lists are split into blocks that meet pairwise; only counts
    and smallest nodes leave a block.

    Null, zero, non-finite vectors, vectors with null components or of an odd length link with nothing: n_links 0,
    component_id = vec_id, kept. A null vec_id takes part; a component of null ids only has a null id. Repeated
    rows are copies of each other. Other columns are ignored; an empty table gives no rows.
    """
    fine = stored(usable(vectors), "vectors")
    train = sample(fine, fit_rows)
    once = fine.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("e").alias("e"))
    once = stored(once.withColumn("node", F.monotonically_increasing_id()), "distinct")
    n = once.count()
    books = fit_codebooks(train, int(np.clip(round(n / list_rows), 1, most_lists)), subspaces, codes)
    shape = "node long, copies long, e array<double>, list int, codes binary, far double, error double"
    coded = stored(once.select("node", "copies", "e").mapInArrow(lambda b: _encode(b, books), shape), "codes")
    blocks, radius = np.ones(len(books.lists), dtype=np.int64), np.zeros(len(books.lists))
    for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each list
        blocks[r["list"]], radius[r["list"]] = -(-r["n"] // BLOCK), r["far"]
    reach = float(np.sqrt(2 - 2 * threshold))
    shape = "list int, block int, kind int, node long, copies long, e array<double>, codes binary, error double"
    dealt = coded.mapInArrow(lambda b: _deal(b, books, blocks, radius, reach), shape)
    dealt = dealt.repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    links = stored(dealt.mapInArrow(lambda b: _compare(b, books, reach, threshold), "node long, links long, peer long"), "links")

    groups = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = once.select("node", "k1", "k2", "copies", "least").join(counts, "node", "left").join(groups, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    heads = known.groupBy("component").agg(F.min("least").alias("head"))
    known = known.join(heads, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "head")
    linked = fine.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", F.col("head").alias("component_id"))

    every = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rest = every.groupBy("vec_id").agg(F.count("*").alias("n")).join(fine.groupBy("vec_id").agg(F.count("*").alias("m")).withColumnRenamed("vec_id", "f_id"), F.col("vec_id").eqNullSafe(F.col("f_id")), "left")
    rest = rest.withColumn("lone", F.col("n") - F.coalesce("m", F.lit(0))).where("lone > 0")
    rest = rest.select("vec_id", F.explode(F.sequence(F.lit(1), F.col("lone"))).alias("_"))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
