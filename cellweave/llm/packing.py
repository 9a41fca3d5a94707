"""Packing token streams into fixed sequences whose windows hold target shares of every source."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import column_of
from cellweave.llm.words import COMMON, SAMPLE_DOCS, common_words
from cellweave.scale import broadcast_if_small
from cellweave.session import stored

PARTS = 100_000  # rows (partition and source) of running totals that may be broadcast, of about 30 bytes each


def _tokenise(batches: Iterator[pa.RecordBatch], end_id: int, common) -> Iterator[pa.RecordBatch]:
    """Ids of every document, and where it starts in its source's stream within this partition."""
    ids_of = common.value.encoder()
    part = TaskContext.get().partitionId()
    at: dict[str | None, int] = {}
    for batch in batches:
        docs, sources = column_of(batch, "doc_id"), column_of(batch, "source")
        for low, high, ids, starts in ids_of.slices(column_of(batch, "text")):
            ids = np.insert(ids, starts[1:], end_id)
            edges = starts + np.arange(len(starts))
            sizes = np.diff(edges)
            local = []
            for source, n in zip(sources.slice(low, high - low).to_pylist(), sizes.tolist(), strict=True):
                local.append(at.get(source, 0))
                at[source] = local[-1] + n
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(edges * 2), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(high - low, part, dtype=np.int32)),
                    docs.slice(low, high - low),
                    sources.slice(low, high - low),
                    pa.array(local, pa.int64()),
                    pa.array(sizes),
                    pc.cast(blobs, pa.binary()),
                ],
                ["part", "doc_id", "source", "local", "tokens", "ids"],
            )


@dataclass(frozen=True)
class Phase:
    """A stretch of windows in which the same sources have tokens left."""

    windows: int
    base: int  # tokens packed before this phase
    first: dict[int, int]  # per queue: where its share of the phase starts in its stream
    share: dict[int, int]  # per queue: its tokens in the phase


def phases(totals: list[int], weights: list[float], window: int) -> list[Phase]:
    """Split the queues into phases: in each, every queue with tokens left is served by its weight.

    A phase ends where the first queue runs out. With weights in proportion to the totals there is one.
    """
    left = {i: n for i, n in enumerate(totals) if n > 0}
    first, base, out = dict.fromkeys(left, 0), 0, []
    while left:
        least = min(left, key=lambda i: (left[i] / weights[i], i))
        time = left[least] / weights[least]
        share = {i: left[i] if left[i] / weights[i] <= time * (1 + 1e-9) else min(left[i], int(weights[i] * time)) for i in left}
        total = sum(share.values())
        out.append(Phase(max(1, -(-total // window)), base, {i: first[i] for i in left}, share))
        base += total
        for i in list(left):
            first[i] += share[i]
            left[i] -= share[i]
            if not left[i]:
                del left[i]
    return out


def _served(share: int, windows: int, w: np.ndarray | int):
    """Tokens of a queue in the first `w` windows.

    Deficit round-robin in closed form: every window credits share / windows tokens, the whole part of the
    credit is served, and the fraction is carried to the next window. Split so that nothing overflows.
    """
    return share // windows * w + share % windows * w // windows


def _pieces(batches: Iterator[pa.RecordBatch], plan: list[Phase], queues: dict[str | None, int], length: int) -> Iterator[pa.RecordBatch]:
    """Cut every document at the windows and sequences it crosses."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc", "start", "length", "crc", "tokens", "sequence", "offset", "window")}
        firsts, sizes = column_of(batch, "first").to_pylist(), column_of(batch, "tokens").to_pylist()
        blobs, sources = column_of(batch, "ids").to_pylist(), column_of(batch, "source").to_pylist()
        for row in range(batch.num_rows):
            q, ids = queues[sources[row]], np.frombuffer(blobs[row], dtype="<u2").astype("<u4")
            for start, n, place, window in _cuts(plan, q, firsts[row], sizes[row], length):
                out["doc"].append(row)
                out["start"].append(start)
                out["length"].append(n)
                out["crc"].append(zlib.crc32(ids[start : start + n].tobytes()))
                out["tokens"].append(sizes[row])
                out["sequence"].append(place // length)
                out["offset"].append(place % length)
                out["window"].append(window)
        docs = column_of(batch, "doc_id").take(pa.array(out.pop("doc"), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [docs, *[pa.array(out[k], pa.int64()) for k in out]],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id"],
        )


def _cuts(plan: list[Phase], q: int, first: int, size: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, tokens, place in the packed stream, window) of each piece of a document."""
    done, passed = 0, 0
    for phase in plan:
        share = phase.share.get(q, 0)
        begin = phase.first.get(q, 0)
        while done < size and share and begin <= first + done < begin + share:
            at = first + done - begin  # within the queue's share of the phase
            w = at * phase.windows // share  # exact up to one; mended below
            while _served(share, phase.windows, w + 1) <= at:
                w += 1
            while _served(share, phase.windows, w) > at:
                w -= 1
            low, high = _served(share, phase.windows, w), _served(share, phase.windows, w + 1)
            before = sum(_served(s, phase.windows, w) for s in phase.share.values())
            ahead = sum(_served(s, phase.windows, w + 1) - _served(s, phase.windows, w) for i, s in phase.share.items() if i < q)
            place = phase.base + before + ahead + at - low
            take = min(size - done, high - at)
            while take:
                n = min(take, length - place % length)
                yield done, n, place, passed + w
                done, place, take = done + n, place + n, take - n
        if done == size:
            return
        passed += phase.windows


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 1,
    window_sequences: int = 32,
    weights: Mapping[str | None, float] | None = None,
    sample_docs: int = SAMPLE_DOCS,
    common_most: int = COMMON,
) -> DataFrame:
    """Pack all documents (`doc_id`, `text`, `source`) into sequences of `length` tokens, mixing sources.

    Deficit round-robin over one queue for each source: every window of about `window_sequences` sequences takes
    from each queue its target share of tokens (`weights`; by default the source's share of all tokens, so
    that no queue runs out early), serves the whole part and carries the deficit to the next window. Running
    totals per partition and source continue the queues, and so the deficits, across partitions. Windows follow
    each other without a gap, so only the last sequence of all is padded.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id;
    ids [start, start + length) of the document stand at `offset` of the sequence. A document may be cut
    anywhere, each of its ids lies in exactly one piece, and its last id is `end_id`.

    Null text counts as empty (one piece that holds `end_id`); null source is a queue of its own; null and
    repeated doc_ids are packed row by row; other columns are ignored; an empty table gives no rows. Sources
    are the names of a mixture: one number for each is kept in every task. Needs a vocabulary of at most
    65,536 ids whose tokens end at white space and between letters and stops. The ids of at most `common_most`
    frequent words of about `sample_docs` documents are sent to every task; this saves work and changes no result.
    """
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("doc_id", kind),
            T.StructField("source", T.StringType()),
            T.StructField("local", T.LongType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    common = common_words(docs, tokenizer, sample_docs, common_most)
    ids = stored(docs.mapInArrow(lambda b: _tokenise(b, end_id, common), schema), "token-ids")
    return _dealt(ids, kind, length, window_sequences, weights)


def _dealt(ids: DataFrame, kind: T.DataType, length: int, window_sequences: int, weights: Mapping[str | None, float] | None) -> DataFrame:
    parts = ids.groupBy("part", "source").agg(F.sum("tokens").alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begun = parts.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begun"))
    rows = sorted(((r["source"], r["n"]) for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is None, r[0]))
    queues, totals = {r[0]: i for i, r in enumerate(rows)}, [r[1] for r in rows]
    targets = [float(weights.get(s, 0)) if weights else float(n) for s, n in rows]
    if any(w <= 0 for w in targets):
        raise ValueError("every source needs a positive weight")
    plan = phases(totals, targets, window_sequences * length)
    begun = broadcast_if_small(stored(begun, "begun"), limit=PARTS)
    placed = ids.join(begun, (ids["part"] == begun["p"]) & ids["source"].eqNullSafe(begun["s"]))
    placed = placed.select("doc_id", "source", (F.col("local") + F.col("begun")).alias("first"), "tokens", "ids")
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id")
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in names]])
    return placed.mapInArrow(lambda b: _pieces(b, plan, queues, length), schema)


def packing_report(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and the share of places that padding to `length` leaves empty."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    total = filled.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return total.withColumn("padding", F.coalesce(1 - F.col("tokens") / (F.col("sequences") * length), F.lit(0.0)))
