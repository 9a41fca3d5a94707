import hashlib
import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm.chat import LAYOUTS, Layout, canonical, digest_chats, fingerprint, format_chats, paths, read_back, records_of_turns, registry, render
from cellweave.llm.packing import _served, pack, packing_report, phases
from cellweave.llm.token_counts import count_pieces, load_pieces, pre_tokens, token_counts
from cellweave.llm.words import WordIds

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"ab ZÉé,.'<|>/\\n▁\n\t0\u0301Σςİ漢🙂sǅÅ", "<s>", "<|endoftext|>", "<|ENDOFTEXT|>", "'S", "  ", "\u1f80", "\x1c"]
ODD = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_pre_tokens_count_like_the_library(text):
    processor = _processor()
    tokens = pre_tokens(text)
    assert sum(count_pieces(processor, tokens)) == len(processor.encode(text))


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_word_ids_equal_the_library(text):
    found = _words().encode(pa.array([text, None, text + " amber"]))
    assert found[0].tolist() == _words().tokenizer.encode(text, add_special_tokens=False).ids
    assert len(found[1]) == 0 and found[2].tolist() == _words().tokenizer.encode(text + " amber", add_special_tokens=False).ids


@cache
def _processor():
    return load_pieces(PIECES)


@cache
def _words():
    return WordIds(WORDS)


def test_token_counts(spark, documents, nothing):
    docs = documents()
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(processor.encode(r["text"] or ""))) for r in docs.collect())
    got = token_counts(docs, PIECES, common=50)  # most pre-tokens take the shuffled join
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got.collect())
    again = token_counts(docs, PIECES)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert token_counts(nothing, PIECES).count() == 0


def test_packing(spark, documents, nothing):
    docs = documents()
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect())
    pieces = pack(docs, WORDS, window_sequences=2)
    rows = pieces.collect()
    total = sum(map(len, want))
    assert sum(r["length"] for r in rows) == total
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 2048 or s == max(by_sequence)
    for ids in ([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.where("doc_id in (1, 8, 12)").collect()):
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_tokens"] == len(ids) and r["doc_id"] in (1, 8, 12))
        for start, length, crc in mine:
            assert zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()) == crc
    assert packing_report(pieces).first()["padding"] < 0.1
    assert pack(nothing, WORDS).count() == 0


def test_windows_hold_the_target_shares(spark):
    data = [(i, "amber " * (50 + i % 40), "big" if i % 3 else "small") for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    pieces = pack(docs, WORDS, window_sequences=2).join(docs.select("doc_id", "source"), "doc_id")
    big = {r["source"]: r["n"] for r in pieces.groupBy("source").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    share = big["big"] / sum(big.values())
    windows = {}
    for r in pieces.collect():
        windows.setdefault(r["window_id"], {}).setdefault(r["source"], []).append(r["length"])
    for w in windows.values():
        n = sum(map(sum, w.values()))
        assert abs(sum(w["big"]) - share * n) <= 2


def test_weights_empty_one_queue_first(spark):
    data = [(i, "amber " * 100, "a" if i % 2 else None) for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    pieces = pack(docs, WORDS, window_sequences=1, weights={"a": 3.0, None: 1.0}).collect()
    assert sum(r["length"] for r in pieces) == 80 * 101
    first = [r for r in pieces if r["window_id"] == 0]
    of_a = sum(r["length"] for r in first if r["doc_id"] % 2)
    assert abs(of_a / sum(r["length"] for r in first) - 0.75) < 0.01
    with pytest.raises(ValueError, match="weight"):
        pack(docs, WORDS, weights={"a": 1.0})


def test_phases_serve_everything():
    plan = phases([100, 0, 7], [1, 1, 1], 10)
    assert sum(sum(p.share.values()) for p in plan) == 107
    assert plan[0].share == {0: 7, 2: 7}
    assert [_served(10, 4, w) for w in range(5)] == [0, 2, 5, 7, 10]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "x\n### y", ":"]), st.text(alphabet="\\#</turn>\n: ab🙂", max_size=30)), max_size=5))
def test_template_round_trip(turns):
    text, spans = render(turns)
    assert read_back(text) == turns
    assert len(spans) == sum(r == "assistant" for r, _ in turns)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "more", "output": "a", "system": "s"},
        {"prompt": "q", "response": "a"},
        {"question": "q", "answer": "a", "context": "c"},
        {"input": {"prompt": "q"}, "output": {"text": "a"}},
        {"messages": []},
        {"unknown": 1},
    ]
    data = [(i, json.dumps(r), "clash") for i, r in enumerate(records)] + [(50, None, ""), (51, "not json", ""), (None, "[1]", "")]
    df = spark.createDataFrame(data, "conv_id long, record string, layout string")
    got = {r["conv_id"]: r for r in format_chats(df).collect()}
    turns = {i: [(t["role"], t["text"]) for t in got[i]["turns"]] for i in range(8)}
    assert turns[0] == turns[1] == turns[2] == turns[4] == turns[6] == [("user", "q"), ("assistant", "a")]
    assert turns[3] == [("system", "s"), ("user", "q\n\nmore"), ("assistant", "a")]
    assert turns[5] == [("user", "c\n\nq"), ("assistant", "a")]
    assert turns[7] == [] and got[7]["formatted"] == ""
    assert got[8]["layout"] is None and got[8]["fingerprint"] and got[50]["formatted"] is None and got[51]["fingerprint"] is None
    assert got[None]["layout"] is None
    digests = {r["conv_id"]: r for r in digest_chats(format_chats(df)).collect()}
    assert digests[0]["loss_sha256"] == hashlib.sha256(b"a").hexdigest() and digests[8]["n_turns"] is None


def test_fingerprints_of_layouts_differ():
    assert len(registry()) == sum(2 ** len(x.optional) for x in LAYOUTS) + sum(x.turns is not None for x in LAYOUTS)
    assert fingerprint(paths({"b": [{"x": 1}], "a": 2})) == fingerprint({"a", "b[]", "b[].x"})
    assert canonical({"t": [{"role": None, "content": None}, 5]}, Layout("t", ("t[]",), turns="t")) == [("user", "")]


def test_turns_of_a_table(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, None, None, "first"), (2, 0, "user", ""), (None, 0, "user", "x"), (2, 0, "user", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in format_chats(records_of_turns(df)).collect()}
    assert got == {1: [("user", "first"), ("user", "hi"), ("assistant", "")], 2: [("user", ""), ("user", "")], None: [("user", "x")]}
    assert format_chats(records_of_turns(df.limit(0))).count() == 0
