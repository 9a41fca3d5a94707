import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm.chunks import LEAST, MOST, Decoder, Joiner, cut, encode_documents, encode_pieces, texts_cut
from cellweave.llm.words import WordIds
from tests.llm.conftest import prose

WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"ab ZÉé,.'<|>/\\n▁\n\t0́Σςİ漢🙂sǅÅ", "<|endoftext|>", "<|endof", "text|>", "'S", "  ", "amber basin ", "ᾀ", "\x1c", " "]


@cache
def tools():
    library = Tokenizer.from_file(WORDS)
    return library, WordIds(WORDS), Joiner(library), Decoder(library)


def pieces_of(texts):
    columns = [c.to_pylist() for c in encode_pieces(tools()[1], texts)]
    return list(zip(*columns, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=1, max_size=6))
def test_any_cut_text_joins_to_the_library_ids(parts):
    library, _, joiner, decoder = tools()
    want = library.encode("".join(parts), add_special_tokens=False).ids
    got = np.frombuffer(joiner.join([pieces_of(parts)])[0], dtype="<u2")
    assert got.tolist() == want
    assert decoder.decode([got, got[:1]]).to_pylist() == [library.decode(want, skip_special_tokens=False), library.decode(want[:1], skip_special_tokens=False)]


def test_cuts_follow_the_content():
    shared = prose(4000, 1)
    texts = pa.array([prose(300, 2) + shared, shared + "end", "", None, "x" * 200_000, "é" * 100_000])
    first, second, empty, null, same, wide = next(texts_cut(texts))
    assert len(set(first.keys) & set(second.keys)) > 0.8 * len(second.keys)
    assert empty.keys == null.keys == [] and empty.borders == [0]
    for c in (first, second, same, wide):
        sizes = np.diff(c.borders)
        assert c.borders[0] == 0 and c.borders[-1] == len(c.text) and sizes.max() <= MOST and (sizes[:-1] >= LEAST).all()
        assert "".join(c.text[a:b].decode() for a, b in zip(c.borders, c.borders[1:], strict=False)) == c.text.decode()
    assert [b.tolist() for b in cut(np.zeros(0, np.uint8), np.array([0, 0]))] == [[0, 0]]


def test_documents(spark, documents, nothing):
    shared = prose(1500, 8)
    more = [(20 + i, prose(50 + 40 * i, 30 + i) + " " + shared + prose(10, i), "a") for i in range(8)]
    more += [(40, "x" * 150_000), (41, "x" * 150_000 + " y"), (42, shared[700:])]
    docs = documents([(m[0], m[1]) for m in more])
    library = tools()[0]
    encoded = encode_documents(docs, WORDS)
    assert encoded.places.count() > 8 and encoded.alone.count() > 3
    want, figures = [], []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"] or -1, ids))
        texts = library.decode(ids, skip_special_tokens=False)
        figures.append((r["doc_id"] or -1, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(texts.encode()).hexdigest()))
    got = [(r["doc_id"] or -1, np.frombuffer(r["ids"], dtype="<u2").tolist()) for r in encoded.per_document().collect()]
    assert sorted(got) == sorted(want)
    digests = encode_documents(docs, WORDS, figures=True).per_document().collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests) == sorted(figures)
    assert encode_documents(nothing, WORDS, figures=True).per_document().count() == 0
