"""Keyword search over stored postings: where every three characters of every text stand.

A term occurs where its pieces of three characters occur at the right distances (one of two characters: where a piece
begins with it), so plain terms are found, counted and placed from the postings alone. A pattern reads only the texts
that hold its literal parts in order. The rarest piece of a term names the places in question; the other pieces are
looked up there.

The index is written in blocks of texts, each with its own postings, so writing it moves no posting to another task: a
document's place is its offset in the block, and where several pieces stand together is found block by block.

A document is a key and a text in lower case: equal rows count once, rows of one key with different texts stay apart,
rows with a null key or text are left out. An empty text has no postings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.search import CONTEXT, searchable
from cellweave.scale import spread

GRAM = 3
BUCKETS = 64
#: Characters from which on a block is closed; it takes a task about forty bytes of memory each.
BLOCK = 1 << 22
#: Folder and gram of the rows that list the documents of a block.
_DOCS = -1
_STEP = (1 << 16) - 1
_MIX = 0x9E3779B97F4A7C15
_END = (1 << 21) - 1  # follows the last character twice, so that every character begins a piece; no code point


def _points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _joined(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Three characters as one number; code points take 21 bits."""
    return (first.astype(np.int64) << 42) | (second.astype(np.int64) << 21) | third


def _grams_of(text: str) -> np.ndarray:
    """One number for each three characters of a text, in order."""
    points = _points_of(text)
    return _joined(points[:-2], points[1:-1], points[2:])


def _rising(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of whole numbers below 2 ** bits, by sixteen bits after the other, which numpy sorts by counting."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The folder of a gram, by its first two characters."""
    return (((grams >> 21).astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(40)).astype(np.int64) % buckets


def _packed(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of rising places, which begin at `starts`, as differences of 16 bits: offsets in bytes, and the numbers.

    A difference of _STEP or more is written as so many times _STEP before what is left of it.
    """
    gaps = np.diff(places, prepend=0)
    gaps[starts] = places[starts]
    after = np.cumsum(gaps // _STEP + 1)
    steps = np.full(after[-1], _STEP, "<u2")
    steps[after - 1] = gaps % _STEP
    return (np.append(np.append(0, after)[starts], after[-1]) * 2).astype(np.int32), steps


def _unpacked(steps: bytes) -> np.ndarray:
    numbers = np.frombuffer(steps, "<u2")
    return numbers.cumsum(dtype=np.int64)[numbers != _STEP]


def _blocks(batches: Iterator[pa.RecordBatch], doc: str, text: str, buckets: int, size: int) -> Iterator[pa.RecordBatch]:
    """Postings of each block of documents: a row for each distinct gram with its places, and one that lists the documents
    with the place where each begins."""
    part, done = TaskContext.get().partitionId(), 0
    keys: list[pa.Array] = []
    versions: list[pa.Array] = []
    texts: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        points = np.concatenate(texts)
        begins = np.cumsum([0, *(len(t) for t in texts[:-1])])
        seen = np.zeros(_END + 1, bool)
        seen[points] = True
        known = np.flatnonzero(seen)
        n = len(known)
        ranks = np.zeros(_END + 1, np.uint32 if n**3 < 1 << 32 else np.uint64)
        ranks[known] = np.arange(n)
        ranked = ranks[points]
        inside = np.flatnonzero(points[:-2] != _END)  # every character of a text begins a piece
        pieces = ((ranked[:-2] * n + ranked[1:-1]) * n + ranked[2:])[inside]
        order = _rising(pieces, (n**3).bit_length())
        risen, places = pieces[order], inside[order]
        first = np.flatnonzero(np.append(True, risen[1:] != risen[:-1]))
        begun = places[first]
        values, rows = _joined(points[begun], points[begun + 1], points[begun + 2]), len(first)

        def last(lists: Sequence[pa.Array]) -> pa.Array:
            """A list in the last row only."""
            values = pa.concat_arrays(lists)
            ends = pa.array([None] * rows + [0, len(values)], pa.int32())
            return pa.ListArray.from_arrays(ends, values)

        ends, steps = _packed(np.append(places, begins), np.append(first, len(places)))
        packed = pa.BinaryArray.from_buffers(pa.binary(), rows + 1, [None, pa.py_buffer(ends), pa.py_buffer(steps)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(_bucket_of(values, buckets), _DOCS)),
                pa.array(np.append(values, _DOCS)),
                pa.array(np.full(rows + 1, (part << 32) + done)),
                packed,
                last(keys),
                last(versions),
            ],
            names=["bucket", "gram", "block", "at", "docs", "versions"],
        )

    for batch in batches:
        for i in range(batch.num_rows):
            value = batch.column(text)[i].as_py()
            if not value:
                continue
            keys.append(batch.column(doc).slice(i, 1))
            versions.append(batch.column("version").slice(i, 1))
            texts.append(np.append(_points_of(value), np.array([_END, _END], "<u4")))
            held += len(texts[-1])
            if held >= size:
                yield block()
                keys, versions, texts, held, done = [], [], [], 0, done + 1
    if texts:
        yield block()


def _versions(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """Key, lower-cased text and the fingerprint that tells texts of one key apart."""
    rows = searchable(documents, text).where(F.col(doc).isNotNull() & F.col(text).isNotNull())
    return rows.select(doc, text, F.xxhash64(text).alias("version"))


def _schema(documents: DataFrame, doc: str) -> T.StructType:
    """Columns of the index; one without any text has no file that could tell them."""
    key = documents.schema[doc].dataType
    return T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("gram", T.LongType()), T.StructField("block", T.LongType()),
        T.StructField("at", T.BinaryType()), T.StructField("docs", T.ArrayType(key)), T.StructField("versions", T.ArrayType(T.LongType())),
    ])


def write_index(
    documents: DataFrame, path: str, doc: str = "doc_id", text: str = "text", buckets: int = BUCKETS, files: int | None = None, block: int = BLOCK
) -> None:
    """Write the postings of all texts to `path`, a folder for each bucket of grams, sorted by gram in each file.

    Every task indexes its own texts in blocks of about `block` characters, so no posting is shuffled, and a gram that a
    third of all texts hold has a row for each block. Few files of documents are dealt over the cores first. What a task
    holds beyond its sort buffer is one block, or one text if that is longer.
    """
    own = documents.select(doc, text)
    rows = _versions(own.repartition(files) if files else spread(own), doc, text)
    postings = rows.mapInArrow(lambda batches: _blocks(batches, doc, text, buckets, block), _schema(rows, doc))
    written = postings.sortWithinPartitions("bucket", "gram").write.option("compression", "zstd")
    written.partitionBy("bucket").mode("overwrite").parquet(path)


def _literals(term: str) -> list[str]:
    """Parts of a pattern that stand in every match, in order; the term itself when it is plain."""
    parts = term.split(".*")
    plain = [p for p in parts if re.fullmatch(r"[a-z0-9 -]+", p)]
    return plain if len(plain) == len(parts) else []


def _overlaps(word: str) -> bool:
    """Whether a word may begin again before it has ended."""
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def _apart(starts: np.ndarray, length: int) -> np.ndarray:
    """Starts from the left on that do not lie in the match before."""
    taken, free = [], -1
    for i, at in enumerate(starts.tolist()):
        if at >= free:
            taken.append(i)
            free = at + length
    return starts[taken]


def _word_places(held: Mapping[int, np.ndarray], word: str) -> np.ndarray:
    """Rising places of a word in a block, overlapping ones too, from the places of the block's grams."""
    if len(word) < GRAM:
        pair = int(_grams_of(word + "\0")[0]) >> 21
        own = [at for g, at in held.items() if g >> 21 == pair]
        return np.sort(np.concatenate(own)) if own else np.zeros(0, np.int64)
    pieces = [(held.get(g), k) for g, k in _pieces(word)]
    if any(at is None for at, _ in pieces):
        return np.zeros(0, np.int64)
    lead, *others = sorted((at - k for at, k in pieces), key=len)
    for at in others:
        near = np.minimum(np.searchsorted(at, lead), len(at) - 1)
        lead = lead[at[near] == lead]
    return lead


def _pieces(word: str) -> list[tuple[int, int]]:
    """Grams that cover a word, with their distances from its begin; the last one may overlap the one before."""
    grams = _grams_of(word)
    return [(int(grams[k]), k) for k in sorted({*range(0, len(grams), GRAM), len(grams) - 1})]


def _in_order(parts: Sequence[str], places: Mapping[str, tuple[np.ndarray, np.ndarray]], docs: int) -> np.ndarray:
    """Whether each document of a block holds the parts one after the other."""
    fits, before = np.full(docs, True), None
    for part in parts:
        which, at = places[part]
        some, first = np.unique(which, return_index=True)
        low, high = np.full(docs, -1), np.full(docs, -1)
        low[some], high[some] = at[first], at[np.append(first, len(at))[1:] - 1]
        fits &= low >= 0
        if before is not None:
            fits &= before <= high
        before = low + len(part)
    return fits


def _find(table: pa.Table, doc: str, plain: Sequence[str], patterns: Mapping[str, Sequence[str]], apart: bool) -> pa.Table:
    """The documents of a block that hold a plain word, with its places, or the parts of a pattern in order."""
    grams = table.column("gram").to_pylist()
    held = {g: _unpacked(at) for g, at in zip(grams, table.column("at").to_pylist())}
    begins = held.pop(_DOCS)
    row = grams.index(_DOCS)
    keys, versions = (table.column(c).combine_chunks()[row].values for c in ("docs", "versions"))
    places = {}
    for word in dict.fromkeys([*plain, *(p for own in patterns.values() for p in own)]):
        at = _word_places(held, word)
        which = np.searchsorted(begins, at, side="right") - 1
        places[word] = which, at - begins[which]
    asked = {term: _in_order(own, places, len(begins)) for term, own in patterns.items()}
    which, slot, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, word in enumerate(plain):
        at = places[word][0] << 32 | places[word][1]  # texts have fewer than 2^31 characters
        at = _apart(at, len(word)) if apart and _overlaps(word) else at
        which, slot, starts = [*which, at >> 32], [*slot, np.full(len(at), k)], [*starts, at & 0xFFFFFFFF]
    which, slot, starts = np.concatenate(which), np.concatenate(slot), np.concatenate(starts)
    order = np.lexsort((starts, slot, which))
    which, slot, starts = which[order], slot[order], starts[order]
    first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (slot[1:] != slot[:-1]))[: len(which)])
    hit = np.zeros(len(begins), bool)
    hit[which] = True
    for fits in asked.values():
        hit |= fits
    rows = np.flatnonzero(hit)
    entries = pa.StructArray.from_arrays(
        [pa.array([plain[k] for k in slot[first]], pa.string()), pa.ListArray.from_arrays(pa.array(np.append(first, len(starts)), pa.int32()), pa.array(starts, pa.int32()))],
        names=["word", "starts"],
    )
    words = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(which[first], rows), len(first)), pa.int32()), entries)
    terms = pa.array([[term for term, fits in asked.items() if fits[i]] for i in rows], pa.list_(pa.string()))
    chosen = pa.array(rows)
    return pa.table([keys.take(chosen), versions.take(chosen), words, terms], names=[doc, "version", "words", "asked"])


def _found(
    spark: SparkSession, path: str, documents: DataFrame, plain: Sequence[str], patterns: Mapping[str, Sequence[str]], doc: str, buckets: int, apart: bool = True
) -> DataFrame:
    """`doc, version, words ARRAY<STRUCT<word, starts>>, asked ARRAY<STRING>`: each document with its plain words and the
    patterns whose literal parts it holds in order, read from the postings. Of `documents`, only the type of the key is used.

    Only the folders of the words' pieces are opened, and the row groups that may hold them; their postings meet by block.
    """
    words = list(dict.fromkeys([*plain, *(p for own in patterns.values() for p in own)]))
    if any(len(w) < 2 for w in words):
        raise ValueError("words of one character are not looked up")
    grams = {g for w in words if len(w) >= GRAM for g, _ in _pieces(w)}
    pairs = {int(_grams_of(w + "\0")[0]) >> 21 for w in words if len(w) == 2}
    folders = sorted(set(_bucket_of(np.array([*grams, *(p << 21 for p in pairs)], np.int64), buckets).tolist()))
    wanted = F.col("gram") == _DOCS
    for gram in sorted(grams):
        wanted = wanted | (F.col("gram") == gram)
    for pair in sorted(pairs):
        wanted = wanted | F.col("gram").between(pair << 21, (pair << 21) + _END)
    key = documents.schema[doc]
    postings = spark.read.schema(_schema(documents, doc)).parquet(path).where(F.col("bucket").isin([_DOCS, *folders]) & wanted).drop("bucket")
    found = postings.groupBy("block").applyInArrow(
        lambda table: _find(table, doc, plain, patterns, apart),
        T.StructType([key, *T.StructType.fromDDL("version long, words array<struct<word string, starts array<int>>>, asked array<string>").fields]),
    )
    return found.dropDuplicates([doc, "version"])  # equal rows are one document


def literal_places(spark: SparkSession, path: str, documents: DataFrame, words: Sequence[str], doc: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """`doc, version, word, starts`: every place (from 0, overlapping ones too) of each word, read from the postings."""
    found = _found(spark, path, documents, list(dict.fromkeys(words)), {}, doc, buckets, apart=False)
    return found.select(doc, "version", F.inline("words"))


def _terms(terms: Mapping[str, Sequence[str]]) -> list[tuple[str, int, str, int]]:
    return [(category, i, term, j) for i, (category, words) in enumerate(terms.items()) for j, term in enumerate(words)]


def _split_terms(terms: Mapping[str, Sequence[str]]) -> tuple[list[str], dict[str, list[str]]]:
    """Plain terms, and patterns with their literal parts."""
    names = list(dict.fromkeys(term for _, _, term, _ in _terms(terms)))
    plain = [t for t in names if _literals(t) == [t]]
    patterns = {t: _literals(t) for t in names if t not in plain}
    unfit = [t for t in names if not _literals(t) or any(len(p) < 2 for p in _literals(t))]
    if unfit:
        raise ValueError(f"terms without literal parts of two characters need a scan of the texts: {unfit}")
    return plain, patterns


def _with_texts(found: DataFrame, documents: DataFrame, doc: str, text: str, all_texts: bool) -> DataFrame:
    """The found documents with their texts: all of them, or those only that are asked for a pattern (others null)."""
    own = _versions(documents.select(doc, text), doc, text).toDF("_doc", text, "_version")
    same = (found[doc] == own["_doc"]) & (found["version"] == own["_version"])
    joined = found.join(own, same, "inner") if all_texts else found.join(own, same & (F.size("asked") > 0), "left")
    return joined.drop("_doc", "_version").dropDuplicates([doc, "version"])


def indexed_matches(
    spark: SparkSession, path: str, documents: DataFrame, terms: Mapping[str, Sequence[str]], doc: str = "doc_id", text: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """`doc, version, word, places ARRAY<STRUCT<at, length>>`: matches of each term that do not overlap, from the left.

    `documents` is read only for the patterns among the terms, and scanned only where their literal parts occur.
    """
    plain, patterns = _split_terms(terms)
    found = _found(spark, path, documents, plain, patterns, doc, buckets)
    if not patterns:
        placed = F.transform("starts", lambda p: F.struct(p.alias("at"), F.length("word").alias("length")))
        return found.select(doc, "version", F.inline("words")).select(doc, "version", "word", placed.alias("places"))
    schema = T.StructType([found.schema[doc], *T.StructType.fromDDL("version long, word string, places array<struct<at int, length int>>").fields])
    return _with_texts(found, documents, doc, text, all_texts=False).mapInArrow(lambda batches: _scan(batches, doc, text), schema)


def _spans(entry: Mapping, asked: Sequence[str], body: str | None) -> Iterator[tuple[str, list[int], list[int]]]:
    """Starts and lengths of the matches of each plain word listed, and of each pattern asked for, in a text."""
    for word in entry:
        yield word["word"], word["starts"], [len(word["word"])] * len(word["starts"])
    for term in asked:
        spans = [m.span() for m in re.finditer(term, body)]
        if spans:
            yield term, [at for at, _ in spans], [stop - at for at, stop in spans]


def _scan(batches: Iterator[pa.RecordBatch], doc: str, text: str) -> Iterator[pa.RecordBatch]:
    """Matches of the plain words and of the patterns in each document, a batch for a batch."""
    for batch in batches:
        rows, words, ends, starts, lengths = [], [], [0], [], []
        for i in range(batch.num_rows):
            for word, at, length in _spans(batch.column("words")[i].as_py(), batch.column("asked")[i].as_py(), batch.column(text)[i].as_py()):
                rows.append(i)
                words.append(word)
                starts += at
                lengths += length
                ends.append(len(starts))
        places = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], names=["at", "length"])
        same = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(doc).take(same), batch.column("version").take(same), pa.array(words, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)],
            names=[doc, "version", "word", "places"],
        )


def _with_categories(spark: SparkSession, matches: DataFrame, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(c, i, t, j, t) for c, i, t, j in _terms(terms)]
    named = spark.createDataFrame(rows, "category string, cat_ord long, term string, term_ord long, word string")
    return matches.join(F.broadcast(named), "word")


def indexed_hits(spark: SparkSession, path: str, documents: DataFrame, terms: Mapping[str, Sequence[str]], doc: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """`doc, category, cat_ord, term, term_ord, hits`, as a scan of all texts would give them."""
    one = _with_categories(spark, indexed_matches(spark, path, documents, terms, doc, text, buckets), terms)
    return one.select(doc, "category", "cat_ord", "term", "term_ord", F.size("places").cast("bigint").alias("hits"))


def indexed_scores(
    spark: SparkSession, path: str, documents: DataFrame, terms: Mapping[str, Sequence[str]], doc: str = "doc_id", text: str = "text", per_term: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """`doc, score, categories`: hits of all terms, each at most `per_term`; categories in list order."""
    one = _with_categories(spark, indexed_matches(spark, path, documents, terms, doc, text, buckets), terms)
    hits = F.size("places").cast("bigint")
    counted = one.select(doc, "version", "category", "cat_ord", (hits if per_term is None else F.least(hits, F.lit(per_term))).alias("n"))
    sums = counted.groupBy(doc, "version").agg(F.sum("n").alias("score"), F.array_sort(F.collect_set(F.struct("cat_ord", "category"))).alias("_c"))
    return sums.select(doc, "score", F.array_join(F.transform("_c", lambda c: c["category"]), "|").alias("categories"))


def indexed_contexts(spark: SparkSession, path: str, documents: DataFrame, terms: Mapping[str, Sequence[str]], doc: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """`doc, category, cat_ord, term, term_ord, k, snippet`: 200 characters around every match.

    The places come from the postings; only texts with a match are joined, each once with the list of its matches.
    """
    plain, patterns = _split_terms(terms)
    found = _found(spark, path, documents, plain, patterns, doc, buckets)
    schema = T.StructType([found.schema[doc], *T.StructType.fromDDL("word string, k long, snippet string").fields])
    one = _with_texts(found, documents, doc, text, all_texts=True).mapInArrow(lambda batches: _snippets(batches, doc, text), schema)
    return _with_categories(spark, one, terms).select(doc, "category", "cat_ord", "term", "term_ord", "k", "snippet")


def _snippets(batches: Iterator[pa.RecordBatch], doc: str, text: str) -> Iterator[pa.RecordBatch]:
    """Stretches around the listed places of the texts, some thousands at a time."""
    for batch in batches:
        keys = batch.column(doc)
        rows: list[tuple[int, str, int, str]] = []

        def cut(rows: list[tuple[int, str, int, str]], keys: pa.Array = keys) -> pa.RecordBatch:
            row, word, k, snippet = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64())), pa.array(word, pa.string()), pa.array(k, pa.int64()), pa.array(snippet, pa.string())],
                names=[doc, "word", "k", "snippet"],
            )

        for i in range(batch.num_rows):
            body = batch.column(text)[i].as_py()
            for word, starts, lengths in _spans(batch.column("words")[i].as_py(), batch.column("asked")[i].as_py(), body):
                for k, (at, length) in enumerate(zip(starts, lengths)):
                    rows.append((i, word, k, body[max(at - CONTEXT, 0) : at + length + CONTEXT].replace("\n", " ").strip(" ")))
                    if len(rows) == 8192:
                        yield cut(rows)
                        rows = []
        if rows:
            yield cut(rows)
