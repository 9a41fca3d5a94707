"""Token ids of whole texts, word by word, for vocabularies in which no token reaches across white space."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column_of, most_frequent

CACHE = 500_000  # words seen by a task whose ids it keeps
SLICE = 8 << 20  # bytes of text looked at together; a longer text comes alone
SAMPLE_DOCS, COMMON = 16_000, 400_000  # texts that tell which words are frequent, and how many of these every task gets


# Words of Latin letters, perhaps with closing stops. The vocabulary cuts between a letter and a stop, and for these
# letters the library's normaliser only takes lower case (a capital I with a dot is left out: it becomes two characters).
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
PLAIN = f"^[{LATIN}]+[.,]*$"


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, .. of each span, one span after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass(frozen=True)
class Known:
    """Ids of different strings: entry i has ids[starts[i] : starts[i] + sizes[i]]."""

    words: pa.Array
    starts: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(words: pa.Array, blobs: list[bytes]) -> Known:
        sizes = np.fromiter((len(b) // 2 for b in blobs), dtype=np.int64, count=len(blobs))
        return Known(words, np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(blobs), dtype="<u2"))


NOTHING = Known(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u2"))


class WordIds:
    """Token ids of texts as the library gives them without special tokens at the ends.

    Each different word of a slice of texts is looked up once, in `common` and in what the task has met before;
    only words met for the first time reach the library.
    """

    def __init__(self, path: str, common: Known | None = None) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        # For small Latin letters without anything else the vocabulary's own normaliser and cutter change nothing.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # tokens that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self.common, self.stops = common or NOTHING, {}
        self.forget()

    def forget(self) -> None:
        """Keep the common words only."""
        self.words, self.starts, self.sizes, self.ids = self.common.words, self.common.starts, self.common.sizes, self.common.ids

    def plus(self, words: pa.Array, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """More words; their spans may lie in the old ids or in the new ones, which follow."""
        self.words = pa.concat_arrays([self.words, words])
        self.starts, self.sizes, self.ids = (np.concatenate(pair) for pair in ((self.starts, starts), (self.sizes, sizes), (self.ids, ids)))

    def by_library(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, and how many each has."""
        found = [f.ids for at in range(0, len(words), 1000) for f in self.tokenizer.encode_batch_fast(words.slice(at, 1000).to_pylist(), add_special_tokens=False)]
        return np.fromiter((i for f in found for i in f), dtype="<u2"), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def small_latin(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of small Latin letters: many go in one text and are told apart by their closing tokens."""
        ids, sizes = [], []
        for at in range(0, len(words), 1000):
            some = words.slice(at, 1000)
            got = np.array(self.bare.encode_batch_fast([" ".join(some.to_pylist())], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = np.flatnonzero(self.closing[got]) + 1
            if len(ends) != len(some):
                got, n = self.by_library(some)
            else:
                n = np.diff(ends, prepend=0)
            ids.append(got)
            sizes.append(n)
        return np.concatenate([np.zeros(0, "<u2"), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def add(self, words: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Add words that are not known yet; gives their places."""
        ids, sizes = encode(words)
        before = len(self.starts)
        self.plus(words, len(self.ids) + np.cumsum(sizes) - sizes, sizes, ids)
        return np.arange(before, before + len(words))

    def place_of(self, words: pa.Array, add: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
        """Places of different words; `add` is given those that are not known yet."""
        place = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            place[new] = add(words.filter(pa.array(new)))
        return place

    def learn(self, words: pa.Array) -> np.ndarray:
        """Add different words that are not known yet; what they share in letters and stops is encoded once."""
        plain = pc.match_substring_regex(words, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.zeros(len(words), dtype=np.int64)
        place[~is_plain] = self.add(words.filter(pc.invert(plain)), self.by_library)
        words = words.filter(plain)
        if not len(words):
            return place
        letters = pc.utf8_rtrim(words, ".,")
        stops = self._after(words, letters).dictionary_encode()
        letters = pc.utf8_lower(letters).dictionary_encode()
        a = self.place_of(letters.dictionary, lambda new: self.add(new, self.small_latin))[letters.indices.to_numpy()]
        for stop in stops.dictionary.to_pylist():
            if stop not in self.stops:
                self.stops[stop] = self.by_library(pa.array([stop]))[0]
        of_stops = [self.stops[stop] for stop in stops.dictionary.to_pylist()]
        own = np.cumsum([0, *map(len, of_stops)])[:-1] + len(self.ids)
        b_sizes = np.array([len(x) for x in of_stops], dtype=np.int64)[stops.indices.to_numpy()]
        b_starts = own[stops.indices.to_numpy()]
        a_starts, a_sizes = self.starts[a], self.sizes[a]
        source = np.concatenate([self.ids, *of_stops])
        ids = source[spans(np.stack([a_starts, b_starts], axis=1).ravel(), np.stack([a_sizes, b_sizes], axis=1).ravel())]
        capitals_only = b_sizes == 0  # the letters alone are known under their small form: no ids of their own
        sizes = a_sizes + b_sizes
        starts = np.where(capitals_only, a_starts, len(self.ids) + np.cumsum(sizes) - sizes)
        before = len(self.starts)
        fresh = letters.dictionary.take(letters.indices)
        twice = pc.equal(fresh, words).to_numpy(zero_copy_only=False)  # small letters without a stop: just added
        spot = np.where(twice, a, before + np.cumsum(~twice) - 1)
        self.plus(words.filter(pa.array(~twice)), starts[~twice], sizes[~twice], ids)
        place[is_plain] = spot
        return place

    @staticmethod
    def _after(words: pa.Array, letters: pa.Array) -> pa.Array:
        """What is left of words behind their letters."""
        ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset + 1 : words.offset + len(words) + 1].astype(np.int64)
        sizes = (pc.binary_length(words).to_numpy() - pc.binary_length(letters).to_numpy()).astype(np.int64)
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[spans(ends - sizes, sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(data))

    def find(self, words: pa.Array) -> np.ndarray:
        """Places of different words, after adding those that are not known yet."""
        if len(self.words) > len(self.common.words) + CACHE:
            self.forget()
        return self.place_of(words, self.learn)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ids of texts [a, b) (null: empty) in a row and where each one's start, for slices of bounded size."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
            yield a, b, *self._encode(texts.slice(a, b - a))
            a = b

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 16-bit numbers."""
        return [x for _, _, ids, starts in self.slices(texts) for x in np.split(ids, starts[1:-1])]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        closed = pc.binary_join_element_wise(pc.cast(pc.fill_null(texts, ""), pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        closed = pa.concat_arrays([closed])
        offsets = np.frombuffer(closed.buffers()[1], dtype=np.int64)[closed.offset : closed.offset + len(closed) + 1]
        data = np.frombuffer(closed.buffers()[2], dtype=np.uint8)[: offsets[-1]]
        cuts = np.flatnonzero((data == 32) | (data == 10)) + 1
        # Words end with their blank; a line break counts as one, so that a word is the same before both.
        data = np.where(data == 10, np.uint8(32), data)
        edges = np.concatenate([[0], cuts]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(edges), pa.py_buffer(data))
        coded = words.dictionary_encode()
        place = self.find(pc.cast(pc.utf8_rtrim(coded.dictionary, " "), pa.string()))
        word = place[coded.indices.to_numpy()]
        size = self.sizes[word]
        flat = self.ids[spans(self.starts[word], size)]
        starts = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(edges, offsets)]
        return flat, starts


class CommonWords:
    """What a broadcast carries: ids of frequent words. A Python worker keeps it, and so its encoder, over its tasks."""

    def __init__(self, path: str, known: Known) -> None:
        self.path, self.known, self.own = path, known, None

    def encoder(self) -> WordIds:
        if self.own is None:
            self.own = WordIds(self.path, self.known)
        return self.own


def _frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[str] = Counter()
        for text in column_of(batch, "text").to_pylist():
            seen.update((text or "").replace("\n", " ").split(" "))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "times"])


def _word_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = WordIds(path)
    for batch in batches:
        words = column_of(batch, "word")
        at = encoder.find(words)
        ids = np.split(encoder.ids[spans(encoder.starts[at], encoder.sizes[at])], np.cumsum(encoder.sizes[at])[:-1])
        yield pa.RecordBatch.from_arrays([words, pa.array([i.tobytes() for i in ids] if len(at) else [], pa.binary())], ["word", "ids"])


def common_words(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, most: int = COMMON) -> Broadcast[CommonWords]:
    """Ids of the at most `most` commonest words of about `sample_docs` documents; they spare work and change no result."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    counted = part.select("text").mapInArrow(_frequent_words, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    table = most_frequent(counted, most).select("word").mapInArrow(lambda b: _word_ids(b, tokenizer), "word string, ids binary").toArrow()
    known = Known.of(pa.concat_arrays([pa.array([], pa.string()), *table["word"].chunks]), table["ids"].to_pylist())
    return docs.sparkSession.sparkContext.broadcast(CommonWords(tokenizer, known))
