"""Token counts from pre-token frequencies: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import column_of, most_frequent
from cellweave.session import stored

SPACE = "▁"  # how the vocabulary writes a space
# A pre-token is a run of spaces with what follows it, or a line break with what follows it.
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    """Split a text where no piece of the vocabulary can reach across; an empty text has none."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def load_pieces(path: str):
    """The library's processor, after checking that pieces never reach across a pre-token's edge."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if "\n" in piece or SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} spans two pre-tokens; this vocabulary can't be counted by pre-token")
    return processor


def count_pieces(processor, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The library puts one space before what it is given, so a leading one is left out."""
    bare = [t[1:] if t[0] == " " else t for t in tokens]
    extra = [0 if t[0] == " " else 1 for t in tokens]  # the space before a line break merges with nothing
    return [len(ids) - e if b else 1 for ids, e, b in zip(processor.encode(bare, num_threads=1), extra, bare, strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    processor = load_pieces(path)
    for batch in batches:
        tokens = column_of(batch, "token")
        yield pa.RecordBatch.from_arrays([tokens, pa.array(count_pieces(processor, tokens.to_pylist()), pa.int32())], ["token", "pieces"])


def _scan(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """One row a document: bytes, tokens of its common pre-tokens, and the frequencies of all others."""
    known = common.value
    has, get, zero = known.__contains__, known.get, itertools.repeat(0)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        sizes, sums, ends, rare, times = [], [], [0], [], []
        for text in column_of(batch, "text").to_pylist():
            tokens = pre_tokens(text or "")
            sizes.append(len((text or "").encode()))
            sums.append(sum(map(get, tokens, zero)))
            left = Counter(itertools.filterfalse(has, tokens))
            rare.extend(left.keys())
            times.extend(left.values())
            ends.append(len(rare))
        n = batch.num_rows
        pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int32())], ["token", "times"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + n)),
                column_of(batch, "doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(sums, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
            ],
            ["row", "doc_id", "n_bytes", "base", "rare"],
        )
        row += n


def token_counts(docs: DataFrame, model: str, limit: int = 4096, sample_docs: int = 20_000, common: int = 400_000) -> DataFrame:
    """Tokens of every whole text as the library for `model` gives them, without special tokens.

    Returns one row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Pieces are counted once for each distinct pre-token and joined to the per-document frequencies; ids are
    never kept. The `common` most frequent pre-tokens of about `sample_docs` documents are joined as a
    broadcast table of that bounded size, all others by a shuffled join; the sample only decides which way
    a pre-token takes, never its count.

    Null and empty texts have 0 bytes and 0 tokens; null and repeated doc_ids keep a row each; an empty table
    gives an empty result; other columns are ignored. Only vocabularies whose pieces end at spaces and line
    breaks are accepted (ValueError otherwise).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = docs.count()
    share = min(1.0, sample_docs / max(rows, 1))
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for text in column_of(batch, "text").to_pylist():
                seen.update(pre_tokens(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "times"])

    frequent = part.select("text").mapInArrow(split, "token string, times long").groupBy("token").agg(F.sum("times").alias("times"))
    frequent = most_frequent(frequent, common).select("token")
    counted = frequent.mapInArrow(lambda b: _pieces(b, model), "token string, pieces int").toArrow()
    table = spark.sparkContext.broadcast(dict(zip(counted["token"].to_pylist(), counted["pieces"].to_pylist(), strict=True)))

    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("base", T.LongType()),
            T.StructField("rare", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("times", T.IntegerType())]))),
        ]
    )
    scanned = stored(docs.mapInArrow(lambda b: _scan(b, table), schema), "pre-tokens")
    rare = scanned.select("row", F.inline("rare"))
    pieces = rare.select("token").distinct().mapInArrow(lambda b: _pieces(b, model), "token string, pieces int")
    more = rare.join(pieces, "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n = F.col("base") + F.coalesce("more", F.lit(0))
    return scanned.drop("rare").join(more, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
