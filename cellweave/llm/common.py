"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import checkpointed, stored

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower())


def with_identity(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `_r1, _r2`: 128 bits that stand for the whole text (null counts as empty).

    Together with the document id they name a row in later joins, so that repeated and null ids are safe;
    rows equal in id and text are one document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_r1": F.xxhash64(body), "_r2": F.xxhash64(F.lit(7), body)})


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Split batches that are sorted by `keys` (no nulls) into one table for each key.

    A key's rows may lie in several batches; only the rows of the current key are held back.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        values = [column_of(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(v[a] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def spread(node: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest node that each node reaches over the links of a block pair."""
    peer = node.copy()
    x, y = np.nonzero(linked)
    x, y = left[x], right[y]
    while True:
        before = peer.copy()
        np.minimum.at(peer, x, peer[y])
        np.minimum.at(peer, y, peer[x])
        if (before == peer).all():
            return peer


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of undirected edges (`a`, `b`, longs): every node with its smallest reachable node.

    Alternates the large-star and small-star steps until the edges stop changing. Each step is a minimum per
    node (combined before the shuffle, so a hub costs nothing) and an inner join that may be split when a hub
    is hot; every round is checkpointed. Nulls and self-loops are ignored. Empty edges give no rows.
    """
    links = edges.where("a is not null and b is not null and a <> b")
    links = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = checkpointed(links)
    state = None
    for _ in range(most):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(nearest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = checkpointed(small.union(least.select("hi", F.col("m").alias("lo"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    nodes = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """Rows of a table with a count `times`, from the highest count down, at most `most` of them.

    Counts are taken or left as a whole, so that no task sorts all rows; a row per different count reaches the driver.
    """
    counted = stored(counted, "counted")
    left, least = most, None
    for r in sorted(counted.groupBy("times").count().collect(), key=lambda r: -r["times"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["times"]
    return counted.where(F.col("times") >= least if least is not None else F.lit(False))
