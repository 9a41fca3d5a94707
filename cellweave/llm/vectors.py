"""Helpers for embedding tables: which vectors count, equal vectors, k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column_of


def usable(vectors: DataFrame) -> DataFrame:
    """Columns vec_id, e (array of doubles), k1, k2 (128 bits that stand for the vector) of the vectors that count.

    Left out are null vectors and vectors that are empty or zero or hold null, NaN or infinite components, and
    those whose length is not the most frequent one (ties: the longer).
    """
    found = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    found = found.where(F.col("e").isNotNull()).where(fine)
    size = found.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    found = found.where(F.size("e") == (size[0]["n"] if size else 0))
    return found.withColumns({"k1": F.xxhash64("e"), "k2": F.xxhash64(F.lit(7), "e")})


def matrix(batch: pa.RecordBatch | pa.Table, name: str = "e") -> np.ndarray:
    """The vectors of a batch as rows of a double matrix."""
    column = batch[name].combine_chunks() if isinstance(batch, pa.Table) else column_of(batch, name)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with the same row of `b`, in double precision."""
    big = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    low = min(np.abs(a).max(axis=1).min(initial=1), np.abs(b).max(axis=1).min(initial=1))
    if big > 1e100 or low < 1e-100:
        a, b = unit(a), unit(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def sample(vectors: DataFrame, rows: int) -> np.ndarray:
    """About `rows` vectors of `usable`, chosen by hash, in a fixed order; unit length."""
    n = vectors.count()
    share = min(1.0, rows / max(n, 1))
    part = vectors.where(F.pmod(F.xxhash64(F.lit(5), "vec_id", "k1"), F.lit(1_000_000)) < int(share * 1_000_000))
    table = part.select("k1", "k2", "e").toArrow().sort_by([("k1", "ascending"), ("k2", "ascending")])
    return unit(matrix(table)) if table.num_rows else np.zeros((0, 1))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(d, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm; starts from different rows, and an empty centre moves to the row farthest from its own."""
    different = np.unique(x, axis=0)
    k = max(1, min(k, len(different)))
    rng = np.random.default_rng(seed)
    centres = different[np.sort(rng.permutation(len(different))[:k])].copy() if len(different) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        d = distances(x, centres)
        mine = d.argmin(axis=1)
        counts = np.bincount(mine, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        far = np.argsort(-d[np.arange(len(x)), mine], kind="stable")
        empty = np.flatnonzero(counts == 0)
        centres = sums / np.maximum(counts, 1)[:, None]
        centres[empty] = x[far[: len(empty)]]
    return centres
