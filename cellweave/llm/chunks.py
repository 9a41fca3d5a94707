"""BPE encoding and decoding with content-defined chunks: chunks that documents share are encoded once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import column_of
from cellweave.llm.words import WordIds, common_words
from cellweave.session import stored

CUT_BITS = 10  # a cut about every 2 ** CUT_BITS bytes after the least size
LEAST, MOST = 256, 65_536  # bytes of a chunk, but for the last one of a text
FILTER_BITS = 1 << 25  # bits of the filter of shared chunks that every task gets (4 MB)
SLICE = 4 << 20  # bytes of text cut, and about as many of ids and decoded text, held at a time
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
# Byte-level names of the white space bytes; a token that holds one would reach across words.
WHITE = "ĠĉĊċČč"


def cut(data: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Chunk borders of each text: text i is data[edges[i] : edges[i + 1]]; both ends are included.

    A border follows a byte where the rolling hash of the 32 bytes up to it is small; it depends on nothing else but
    the last border, so that equal passages are cut alike in every document. Borders never split a character.
    """
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        rolled = h.copy()
        rolled[shift:] += h[:-shift] << np.uint32(shift)
        h = rolled
    at = np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1
    starts = (data & 0xC0) != 0x80  # first bytes of characters
    at = at[at < len(data)]
    at = at[starts[at]]
    lows, highs = np.searchsorted(at, edges[:-1], side="right"), np.searchsorted(at, edges[1:], side="left")
    out = []
    for a, b, lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), lows.tolist(), highs.tolist(), strict=True):
        borders, last = [a], a
        for c in [*at[lo:hi].tolist(), b]:
            while c - last > MOST:
                last += MOST
                while not starts[last]:
                    last -= 1
                borders.append(last)
            if c - last >= LEAST and c < b:
                borders.append(c)
                last = c
        out.append(np.array([*borders, b]))
    return out


@dataclass(frozen=True)
class Cut:
    """One text of a batch: its row, bytes, fingerprint, and its chunks' borders (in the bytes) and keys."""

    row: int
    text: bytes
    name: tuple[int, int]
    borders: list[int]
    keys: list[tuple[int, int]]


def _key(part: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(part)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def texts_cut(texts: pa.Array) -> Iterator[list[Cut]]:
    """Texts (null: empty) with their chunks, in slices of bounded size; a longer text comes alone."""
    rows, size = [], 0
    for row, text in enumerate(texts):
        raw = (text.as_py() or "").encode()
        rows.append((row, raw))
        size += len(raw)
        if size >= SLICE:
            yield _cut_all(rows)
            rows, size = [], 0
    if rows:
        yield _cut_all(rows)


def _cut_all(rows: list[tuple[int, bytes]]) -> list[Cut]:
    edges = np.cumsum([0, *[len(raw) for _, raw in rows]])
    data = np.frombuffer(b"".join(raw for _, raw in rows), dtype=np.uint8)
    out = []
    for (row, raw), borders in zip(rows, cut(data, edges), strict=True):
        own = (borders - borders[0]).tolist() if raw else [0]
        out.append(Cut(row, raw, _key(raw), own, [_key(raw[a:b]) for a, b in zip(own, own[1:], strict=False)]))
    return out


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of every text and of its chunks."""
    chunk = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))
    for batch in batches:
        for some in texts_cut(column_of(batch, "text")):
            docs = column_of(batch, "doc_id").take(pa.array([c.row for c in some], pa.int64()))
            keys = [[{"k1": a, "k2": b} for a, b in c.keys] for c in some]
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array([c.name[0] for c in some], pa.int64()), pa.array([c.name[1] for c in some], pa.int64()), pa.array(keys, chunk)],
                ["doc_id", "t1", "t2", "chunks"],
            )


class Filter:
    """Which chunks may be shared: two bits for each shared chunk. The rare false yes costs a move, not a result."""

    def __init__(self, shared: DataFrame) -> None:
        bits = shared.select(F.explode(F.array("k1", "k2")).alias("k")).select(F.pmod("k", F.lit(FILTER_BITS)).alias("p"))
        word = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
        self.words[word["w"].to_numpy()] = word["bits"].to_numpy()

    def has(self, keys: list[tuple[int, int]] | np.ndarray) -> np.ndarray:
        p = np.array(keys, dtype=np.int64).reshape(-1, 2) % FILTER_BITS
        return ((self.words[p >> 6] >> (p & 63)) & 1).all(axis=1)


PIECE = ["open", "head", "head_n", "ids", "tail", "tail_n"]
PIECE_TYPES = [pa.bool_(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
PIECE_DDL = "open boolean, head string, head_n long, ids binary, tail string, tail_n long"


def encode_pieces(encoder: WordIds, texts: list[str]) -> list[pa.Array]:
    """Columns `PIECE` of pieces of text whose ends may lie within words.

    The words but the first and last are encoded: their ids stand whatever surrounds the piece. `head` is the first
    and second word, `tail` the last two; head_n and tail_n ids belong to the second and the last but one, so that
    a join can show that it agrees with both sides. A piece of fewer than four words is open: `head` is its text.
    """
    rows, inner, guards = [], [], []
    for text in texts:
        t = text.replace("\n", " ")
        i = t.find(" ")
        i2, j = t.find(" ", i + 1), t.rfind(" ")
        j2 = t.rfind(" ", 0, max(j, 0))
        if i2 < 0 or j2 < i2:
            rows.append((True, text, None, None))
        else:
            rows.append((False, t[:i2], len(inner), t[j2 + 1 :]))
            inner.append(t[i + 1 : j])
            guards += [t[i + 1 : i2], t[j2 + 1 : j]]
    ids = [x.tobytes() for x in encoder.encode(pa.array(inner, pa.string()))]
    sizes = [len(x) for x in encoder.encode(pa.array(guards, pa.string()))]
    columns = [
        [r[0] for r in rows],
        [r[1] for r in rows],
        [None if r[0] else sizes[2 * r[2]] for r in rows],
        [None if r[0] else ids[r[2]] for r in rows],
        [r[3] for r in rows],
        [None if r[0] else sizes[2 * r[2] + 1] for r in rows],
    ]
    return [pa.array(c, t) for c, t in zip(columns, PIECE_TYPES, strict=True)]


def _shared_texts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Text of each chunk that may be shared, once a slice of documents."""
    for batch in batches:
        for some in texts_cut(column_of(batch, "text")):
            found: dict[tuple[int, int], bytes] = {}
            keys = [k for c in some for k in c.keys]
            hit = iter(shared.value.has(keys).tolist())
            for c in some:
                for a, b, k in zip(c.borders, c.borders[1:], c.keys, strict=False):
                    if next(hit):
                        found[k] = c.text[a:b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array([t.decode() for t in found.values()], pa.string())],
                ["k1", "k2", "text"],
            )


def _encode_chunks(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    encoder = common.value.encoder()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([column_of(batch, "k1"), column_of(batch, "k2"), *encode_pieces(encoder, column_of(batch, "text").to_pylist())], ["k1", "k2", *PIECE])


def _alone(batches: Iterator[pa.RecordBatch], common, shared) -> Iterator[pa.RecordBatch]:
    """Ids of the documents without a shared chunk."""
    encoder = common.value.encoder()
    for batch in batches:
        for some in texts_cut(column_of(batch, "text")):
            ends = np.cumsum([0, *[len(c.keys) for c in some]])
            hits = np.concatenate([[0], np.cumsum(shared.value.has([k for c in some for k in c.keys]))])
            mine = [c for c, n in zip(some, np.diff(hits[ends]).tolist(), strict=True) if not n]
            ids = [x.tobytes() for x in encoder.encode(pa.array([c.text.decode() for c in mine], pa.string()))]
            docs = column_of(batch, "doc_id").take(pa.array([c.row for c in mine], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.binary())], ["doc_id", "ids"])


def _between(batches: Iterator[pa.RecordBatch], common, shared) -> Iterator[pa.RecordBatch]:
    """What lies between shared chunks, of the documents that have some: neighbouring chunks are one piece."""
    encoder = common.value.encoder()
    for batch in batches:
        for some in texts_cut(column_of(batch, "text")):
            hit, at = shared.value.has([k for c in some for k in c.keys]).tolist(), 0
            names, ordinals, texts = [], [], []
            for c in some:
                mine, at = hit[at : at + len(c.keys)], at + len(c.keys)
                first = None
                for i, is_shared in enumerate([*mine, True] if any(mine) else []):
                    if is_shared and first is not None:
                        names.append(c.name)
                        ordinals.append(first)
                        texts.append(c.text[c.borders[first] : c.borders[i]].decode())
                        first = None
                    elif not is_shared and first is None:
                        first = i
            key = [pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array(ordinals, pa.int32())]
            yield pa.RecordBatch.from_arrays([*key, *encode_pieces(encoder, texts)], ["t1", "t2", "ordinal", *PIECE])


def _may_be_shared(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.stack([column_of(batch, "k1").to_numpy(), column_of(batch, "k2").to_numpy()], axis=1)
        yield batch.filter(pa.array(shared.value.has(keys)))


class Joiner:
    """Ids of whole texts from their pieces: every join is encoded anew, from the last word of the one side that a
    cut leaves whole to the first such word of the other, over as many open pieces as lie between."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        if any(len(t) > 1 and set(t) & set(WHITE) for t in (token.removesuffix("</w>") for token in self.tokenizer.get_vocab())):
            raise ValueError("tokens of this vocabulary reach across white space; joins can't be told to agree")

    def join(self, texts: list[list[tuple]]) -> list[bytes]:
        """`texts` holds each text's pieces in order, as tuples of `PIECE`."""
        windows = []
        for pieces in texts:
            pending = ""
            for open_, head, _, _, tail, _ in pieces:
                if open_:
                    pending += head
                else:
                    windows.append(pending + head)
                    pending = tail
            windows.append(pending)
        found = iter(self.tokenizer.encode_batch_fast(windows, add_special_tokens=False))
        return [self._join(pieces, found) for pieces in texts]

    def _join(self, pieces: list[tuple], windows: Iterator) -> bytes:
        out, before, guard = [], b"", 0
        for open_, _, head_n, ids, _, tail_n in [*pieces, (False, "", 0, b"", "", 0)]:
            if open_:
                continue
            new = np.array(next(windows).ids, dtype="<u2").tobytes()
            if before[len(before) - 2 * guard :] != new[: 2 * guard] or new[len(new) - 2 * head_n :] != ids[: 2 * head_n]:
                raise RuntimeError("a join does not agree with its sides")
            out += [new[2 * guard : len(new) - 2 * head_n], ids]
            before, guard = ids, tail_n
        return b"".join(out)


def _assemble(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """Pieces come by text and place; ids of whole texts leave in batches of bounded size."""
    joiner = Joiner(common.value.encoder().tokenizer)
    name, pieces, names, texts, size = None, [], [], [], 0

    def done() -> pa.RecordBatch:
        ids = joiner.join(texts)
        return pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array(ids, pa.binary())], ["t1", "t2", "ids"])

    for batch in batches:
        rows = zip(*[column_of(batch, c).to_pylist() for c in ("t1", "t2", *PIECE)], strict=True)
        for t1, t2, *piece in rows:
            if (t1, t2) != name:
                if size >= SLICE // 2:
                    yield done()
                    names, texts, size = [], [], 0
                name, pieces = (t1, t2), []
                names.append(name)
                texts.append(pieces)
            pieces.append(piece)
            size += len(piece[1]) + len(piece[3] or b"")
    if names:
        yield done()


@dataclass(frozen=True)
class Encoded:
    """Token ids, little-endian unsigned 16-bit: `alone` (doc_id, ids) are documents without a shared chunk; the others
    are `places` (doc_id, t1, t2) of `texts` (t1, t2, ids), each different text once. In place of `ids` may stand
    the figures that `encode_documents` was asked for."""

    alone: DataFrame
    texts: DataFrame
    places: DataFrame

    def per_document(self) -> DataFrame:
        """One row per document."""
        texts = self.texts.withColumnsRenamed({"t1": "x1", "t2": "x2"})
        joined = self.places.join(texts, (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2"))).drop("t1", "t2", "x1", "x2")
        return self.alone.unionByName(joined)


def encode_documents(docs: DataFrame, tokenizer: str, figures: bool = False) -> Encoded:
    """Token ids of every whole text (`doc_id`, `text`) as the library gives them without special tokens.

    With `figures`, n_tokens, ids_sha256 (of unsigned 32-bit little-endian ids) and decoded_sha256 (of the text decoded
    from the ids, special tokens included) are taken from the ids in the tasks that have them, and replace them.

    Texts are cut where a rolling hash of their last 32 bytes is small, so a passage is cut alike wherever it stands.
    Chunks that occur once are encoded where they lie, neighbours together. Each chunk that occurs more often is
    encoded once, and its ids are joined to the places where it occurs, once for each different text. Then every join of
    pieces is encoded anew, over the cut words and one whole word of both sides, whose ids must equal those that the
    sides have: the words between are exact then, since no token of the vocabulary reaches across white space
    (ValueError otherwise).

    Null text counts as empty and has no ids; null and repeated doc_ids and repeated rows keep their rows; an empty table
    gives no rows; other columns are ignored. Special strings within texts become special tokens, as the
    library's default has it. Chunks and texts are told apart by 128 bits. Tasks hold 4 MB of filter and the ids of frequent
    words; whatever the filter takes for shared is moved, so that at worst all chunks are.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"]
    chunk = T.ArrayType(T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]))
    long = lambda n: T.StructField(n, T.LongType())
    named = stored(docs.mapInArrow(_names, T.StructType([kind, long("t1"), long("t2"), T.StructField("chunks", chunk)])), "chunk-names")
    occurring = named.select("t1", "t2", F.posexplode("chunks").alias("ordinal", "c")).select("t1", "t2", "ordinal", "c.k1", "c.k2")
    shared = Filter(occurring.groupBy("k1", "k2").count().where("count > 1"))
    sent, common = spark.sparkContext.broadcast(shared), common_words(docs, tokenizer)

    texts = docs.select("text").mapInArrow(lambda b: _shared_texts(b, sent), "k1 long, k2 long, text string")
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    chunks = texts.mapInArrow(lambda b: _encode_chunks(b, common), f"k1 long, k2 long, {PIECE_DDL}")
    chunks = chunks.withColumnsRenamed({"k1": "c1", "k2": "c2"})
    refs = occurring.mapInArrow(lambda b: _may_be_shared(b, sent), occurring.schema).dropDuplicates(["t1", "t2", "ordinal"])
    refs = refs.join(chunks, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).select("t1", "t2", "ordinal", *PIECE)
    between = docs.mapInArrow(lambda b: _between(b, common, sent), f"t1 long, t2 long, ordinal int, {PIECE_DDL}")
    pieces = refs.unionByName(between).repartition("t1", "t2").sortWithinPartitions("t1", "t2", "ordinal")
    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if figures else [T.StructField("ids", T.BinaryType())]
    finish = _figures if figures else lambda ids, common: ids
    whole = pieces.mapInArrow(lambda b: finish(_assemble(b, common), common), T.StructType([long("t1"), long("t2"), *out]))
    alone = docs.mapInArrow(lambda b: finish(_alone(b, common, sent), common), T.StructType([kind, *out]))
    any_shared = lambda b: _with_shared(b, sent)
    places = named.mapInArrow(any_shared, T.StructType([kind, long("t1"), long("t2")]))
    return Encoded(alone, whole, places)


def _with_shared(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = column_of(batch, "chunks")
        flat = chunks.flatten()
        keys = np.stack([flat.field("k1").to_numpy(), flat.field("k2").to_numpy()], axis=1)
        hits = np.concatenate([[0], np.cumsum(shared.value.has(keys))])
        ends = np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy())]).astype(np.int64)
        some = batch.filter(pa.array(np.diff(hits[ends]) > 0))
        yield some.select(["doc_id", "t1", "t2"])


class Decoder:
    """Texts of token ids, special tokens included, as the library's decode gives them."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        size = self.tokenizer.get_vocab_size()
        self.plain = self.tokenizer.decoder is None  # then tokens are put one after another with blanks between
        self.tokens = pa.array([self.tokenizer.id_to_token(i) for i in range(size)], pa.large_string())

    def decode(self, ids: list[np.ndarray]) -> pa.Array:
        """Texts as large strings."""
        if not self.plain:
            return pa.array(self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False), pa.large_string())
        ends = np.cumsum([0, *map(len, ids)])
        tokens = self.tokens.take(pa.array(np.concatenate([np.zeros(0, "<u2"), *ids]).astype(np.int32)))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), tokens), pa.scalar(" ", pa.large_string()))


def _figures(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """Replace `ids` by how many they are and by hashes of them and of the decoded text."""
    decoder = Decoder(common.value.encoder().tokenizer)
    for batch in batches:
        blobs = column_of(batch, "ids").to_pylist()
        ends = np.cumsum([len(b) // 2 for b in blobs])
        counts, ids_sha, text_sha, a = [], [], [], 0
        while a < len(blobs):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE // 4, side="right")))
            ids = [np.frombuffer(blob, dtype="<u2") for blob in blobs[a:b]]
            texts = decoder.decode(ids)
            edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
            data = memoryview(texts.buffers()[2]) if edges[-1] else memoryview(b"")
            counts += map(len, ids)
            ids_sha += [hashlib.sha256(i.astype("<u4")).hexdigest() for i in ids]
            text_sha += [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(edges, edges[1:], strict=False)]
            a = b
        others = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "ids"]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*others, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])
