"""Similarity join of documents by the Jaccard index of their word n-grams, over a MinHash LSH forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column_of, components, runs, spread, with_identity, words
from cellweave.session import stored

KNOWN_WORDS = 300_000  # word hashes that a task keeps
BLOCK = 256  # documents of one side of a block pair


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sets of hashed word n-grams."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.known: dict[str, int] = {}
        self.step = np.random.default_rng(5).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))

    def grams(self, h: np.ndarray) -> np.ndarray:
        """Hash of every n-gram in order; fewer than n words are one gram, none are none."""
        m = min(self.n, len(h))
        if m == 0:
            return h
        size = len(h) - m + 1
        out = np.full(size, m, dtype=np.uint64)
        for k in range(m):
            out += h[k : k + size] * self.step[k]
        return _mixed(out)


def _key(h: np.ndarray) -> tuple[int, int]:
    data = h.tobytes()
    a, b = xxhash.xxh3_64_intdigest(data), xxhash.xxh3_64_intdigest(data, seed=11)
    return a - (1 << 63), b - (1 << 63)


def _signatures(batches: Iterator[pa.RecordBatch], n: int, trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Per document: key of its word sequence, number of different n-grams, 16 bits of each minimum."""
    shingler = Shingler(n)
    rng = np.random.default_rng(17)
    flip = rng.integers(0, 2**32, size=(trees * depth, 1), dtype=np.uint32)
    odd = rng.integers(0, 2**31, size=(trees * depth, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    keep = ["doc_id", "_r1", "_r2"]
    for batch in batches:
        k1, k2, sizes, signs = [], [], [], []
        for text in column_of(batch, "text").to_pylist():
            h = shingler.hashes(words(text or ""))
            grams = np.unique(shingler.grams(h))
            a, b = _key(h) if len(h) else (None, None)
            k1.append(a)
            k2.append(b)
            sizes.append(len(grams))
            if not len(grams):
                signs.append(None)
                continue
            low = (grams >> np.uint64(32)).astype(np.uint32)[None, :]
            least = np.full((trees * depth, 1), 2**32 - 1, dtype=np.uint32)
            for at in range(0, low.shape[1], 512):
                h32 = (low[:, at : at + 512] ^ flip) * odd
                h32 ^= h32 >> np.uint32(15)
                least = np.minimum(least, (h32 * np.uint32(0x2C1B3C6D)).min(axis=1, keepdims=True))
            signs.append((_mixed(least[:, 0].astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays(
            [*[column_of(batch, c) for c in keep], pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())],
            [*keep, "k1", "k2", "n", "sign"],
        )


def _gram_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(n)
    for batch in batches:
        sets = [np.unique(shingler.grams(shingler.hashes(words(t or "")))).tobytes() for t in column_of(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([column_of(batch, "node"), column_of(batch, "copies"), pa.array(sets, pa.binary())], ["node", "copies", "grams"])


def _labels(signs: list[bytes], trees: int, depth: int) -> np.ndarray:
    """(documents, trees, prefix length): a hash of each tree's prefix of 1..depth values."""
    x = np.frombuffer(b"".join(signs), dtype="<u2").reshape(len(signs), trees, depth).astype(np.uint64)
    odd = np.random.default_rng(23).integers(1, 2**63, size=depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _mixed(np.cumsum(x * odd, axis=2, dtype=np.uint64) + np.arange(depth, dtype=np.uint64))


def _fresh(labels: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int, d: int, threshold: float) -> np.ndarray:
    """Pairs (left x right) whose first tree with an equal prefix of d is `tree`, and that no longer prefix found.

    Pairs whose set sizes rule out the threshold are left out.
    """
    a, b = labels[left], labels[right]
    found = a[:, None, tree, d - 1] == b[None, :, tree, d - 1]
    small = np.minimum(sizes[left][:, None], sizes[right][None, :])
    found &= small >= threshold * np.maximum(sizes[left][:, None], sizes[right][None, :])
    for t in range(labels.shape[1]):
        if not found.any():
            break
        if t < tree:
            found &= a[:, None, t, d - 1] != b[None, :, t, d - 1]
        if d < labels.shape[2]:
            found &= a[:, None, t, d] != b[None, :, t, d]
    return found


def _sides(table: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    block = table["block"].to_numpy()
    every = np.arange(len(block))
    return (every, every) if i == j else (every[block == i], every[block == j])


def _candidates(batches: Iterator[pa.RecordBatch], trees: int, depth: int, d: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Keep the rows of a block pair that belong to at least one pair to verify there."""
    for table in runs(batches, ["bucket", "i", "j"]):
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = _sides(table, i, j)
        if not len(left) or not len(right):
            continue
        labels = _labels(table["sign"].to_pylist(), trees, depth)
        fresh = _fresh(labels, table["n"].to_numpy(), left, right, table["tree"][0].as_py(), d, threshold)
        if i == j:
            np.fill_diagonal(fresh, False)
        keep = np.union1d(left[fresh.any(axis=1)], right[fresh.any(axis=0)])
        if len(keep):
            yield from table.take(pa.array(keep)).combine_chunks().to_batches()


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the wanted pairs."""
    out = np.zeros(wanted.shape, dtype=np.int64)
    if wanted.sum() <= 4 * (len(left) + len(right)):
        for x, y in zip(*np.nonzero(wanted), strict=True):
            out[x, y] = len(np.intersect1d(sets[left[x]], sets[right[y]], assume_unique=True))
        return out
    every = np.unique(np.concatenate(sets))
    places = [np.searchsorted(every, s) for s in sets]
    for low in range(0, len(every), 4096):
        dense = np.zeros((len(sets), 4096), dtype=np.float32)
        for row, p in enumerate(places):
            a, b = np.searchsorted(p, (low, low + 4096))
            dense[row, p[a:b] - low] = 1
        out += (dense[left] @ dense[right].T).astype(np.int64)
    return out


def _verified(batches: Iterator[pa.RecordBatch], trees: int, depth: int, d: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard of the candidates of each block pair.

    Rows: node, links (documents linked here, copies counted), peer (smallest node reached here); and rows
    without node that count the found pairs by similarity (`hundredth`).
    """
    for table in runs(batches, ["bucket", "i", "j"]):
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = _sides(table, i, j)
        if not len(left) or not len(right):
            continue
        sets = [np.frombuffer(g, dtype=np.uint64) for g in table["grams"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        fresh = _fresh(_labels(table["sign"].to_pylist(), trees, depth), sizes, left, right, table["tree"][0].as_py(), d, threshold)
        if i == j:
            fresh = np.triu(fresh, 1)
        if not fresh.any():
            continue
        both = _shared(sets, left, right, fresh)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked = fresh & (both >= threshold * union)
        if not linked.any():
            continue
        copies, node = table["copies"].to_numpy(), table["node"].to_numpy()
        links = np.zeros(len(node), dtype=np.int64)
        np.add.at(links, left, linked @ copies[right])
        np.add.at(links, right, copies[left] @ linked)
        peer = spread(node, left, right, linked)
        some = np.flatnonzero(links)
        bins = np.bincount(np.floor(both[linked] / union[linked] * 100 + 1e-9).astype(int))
        seen = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*node[some].tolist(), *[None] * len(seen)], pa.int64()),
                pa.array([*links[some].tolist(), *bins[seen].tolist()], pa.int64()),
                pa.array([*peer[some].tolist(), *[None] * len(seen)], pa.int64()),
                pa.array([*[None] * len(some), *seen.tolist()], pa.int32()),
            ],
            ["node", "links", "peer", "hundredth"],
        )


def found_share(similarity: float, trees: int, d: int) -> float:
    """Chance that a pair of this similarity shares a prefix of `d` values in one of the trees."""
    return 1 - (1 - similarity**d) ** trees


def ngram_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, trees: int = 24, depth: int = 6
) -> DataFrame:
    """Group documents whose sets of word n-grams have a Jaccard index of at least `threshold`.

    Returns one row per input row: doc_id, class_id (smallest doc_id reachable over links), n_links (other
    documents linked directly, copies included), kept (the first document of its class), _r1, _r2 (which
    text, see `with_identity`).

    Documents with the same words (runs of letters and digits, lower case) are one node. Each node gets
    `trees` MinHash sequences of `depth` values; sorted, they form prefix tries whose nodes are the groups of
    equal prefixes. The join starts at whole prefixes and shortens them by one value at a time. After each
    round the recall is estimated from the verified pairs, each weighted by its chance to be found at this
    length, until it reaches `recall`. Every candidate pair is verified once by its exact sets, in the first
    tree that shows it. Groups of a trie larger than a block are joined block by block, so no pairs are
    written out and none is dropped; each block pair returns counts and the smallest node reached.

    Null and empty texts, and texts without letters or digits, link with nothing. Texts of fewer than n words
    are one n-gram. A null doc_id takes part; a class of null ids only has a null class_id. Rows equal in
    doc_id and text count as copies, and all of them are `kept` if one is. An empty table gives no rows.
    """
    docs = with_identity(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(
        lambda b: _signatures(b, n, trees, depth), f"doc_id {kind}, _r1 long, _r2 long, k1 long, k2 long, n int, sign binary"
    )
    signed = stored(signed, "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_r1", "_r2")).alias("first")
    nodes = signed.where("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("copies"), first, F.first("n").alias("n"), F.first("sign").alias("sign"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    results, counts, d = [], {}, depth
    while True:
        found = _round(docs, nodes, kind, n, trees, depth, d, threshold)
        results.append(found.where("node is not null").select("node", "links", "peer"))
        for r in found.where("node is null").groupBy("hundredth").agg(F.sum("links").alias("pairs")).collect():
            counts[r["hundredth"]] = counts.get(r["hundredth"], 0) + r["pairs"]
        expected = sum(c / found_share(max(threshold, h / 100), trees, d) for h, c in counts.items())
        reached = sum(counts.values()) / expected if counts else found_share(threshold, trees, d)
        if reached >= recall or d == 1:
            break
        d -= 1

    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    links = every.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(every.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    linked = nodes.select("node", "k1", "k2", "copies", "first").join(links, "node", "left").join(groups, "node", "left")
    linked = linked.withColumn("component", F.coalesce("component", "node"))
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "head"
    )
    out = signed.select("doc_id", "_r1", "_r2", "k1", "k2").join(linked, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("_r1") == F.col("head._r1")) & (F.col("_r2") == F.col("head._r2"))
    return out.select(
        "doc_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("head").isNull(), True).otherwise(is_head).alias("kept"),
        "_r1",
        "_r2",
    )


def _round(docs: DataFrame, nodes: DataFrame, kind: str, n: int, trees: int, depth: int, d: int, threshold: float) -> DataFrame:
    """Verified links of the pairs whose longest shared prefix over all trees has `d` values."""
    prefix = lambda t: F.substring("sign", t * 2 * depth + 1, 2 * d)
    labels = F.array(*[F.xxhash64(F.lit(t), prefix(t)) for t in range(trees)])
    entries = nodes.select("node", F.posexplode(labels).alias("tree", "bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    live = entries.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tree", "node")
    live = live.join(nodes.select("node", "n", "sign"), "node").select("bucket", "i", "j", "block", "tree", "node", "n", "sign")
    shape = "bucket long, i int, j int, block int, tree int, node long, n int, sign binary"
    some = live.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(lambda b: _candidates(b, trees, depth, d, threshold), shape)
    some = stored(some, "candidates")

    # The sets of the nodes that are in some pair, from one document of each.
    wanted = nodes.join(some.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", "copies", F.col("first.doc_id").alias("w_id"), F.col("first._r1").alias("w1"), F.col("first._r2").alias("w2"))
    texts = docs.join(wanted.hint("shuffle_hash"), (F.col("_r1") == F.col("w1")) & (F.col("_r2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    sets = texts.select("node", "copies", "text").mapInArrow(lambda b: _gram_sets(b, n), "node long, copies long, grams binary")
    sets = sets.dropDuplicates(["node"])
    pairs = some.join(sets, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = pairs.mapInArrow(lambda b: _verified(b, trees, depth, d, threshold), "node long, links long, peer long, hundredth int")
    return stored(found, "links")
