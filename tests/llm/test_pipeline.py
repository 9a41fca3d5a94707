import collections
import math
import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cellweave.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import prose
from tests.llm.test_classifiers import junk
from tests.llm.test_dedup import brute, near_family

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    passage = prose(60, 500)
    rows = [(i, prose(50 + i % 40, 2000 + i)) for i in range(120)]
    rows += [(200 + i, junk(i)) for i in range(12)]
    rows += [(300, rows[5][1]), *[(310 + i, t.replace("\n", " ")) for i, (_, t) in enumerate(near_family(6, 501, 0))]]
    rows += [(320 + i, f"{prose(36, 700 + i)}\n{passage}") for i in range(4)]
    rows += [(400, None), (401, ""), (None, prose(44, 502))]
    data = [(i, t, "en", "hot" if k % 3 == 0 else f"s{k % 4}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(data, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        seen[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    clean = {*range(120), None}
    assert not ids["quality"] & {*range(200, 212), 400, 401} and clean <= ids["quality"]
    assert 300 not in ids["lines"] and clean <= ids["lines"]
    passage = prose(60, 500).split("\n")[1]
    assert [r["doc_id"] for r in seen["lines"] if passage in r["text"]] == [320]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["lines"])
    want = brute([(r["doc_id"], r["text"]) for r in seen["lines"]])
    assert sorted(map(str, ids["near_copies"])) == sorted({str(g) for _, g, _ in want})
    assert ids["mixture"] <= ids["near_copies"] and ids["mixture"] & clean
    words = collections.Counter()
    for r in seen["mixture"]:
        words[r["source"]] += len(re.findall(r"\S+", r["text"]))
    before = collections.Counter()
    for r in seen["near_copies"]:
        before[r["source"]] += len(re.findall(r"\S+", r["text"]))
    assert words["hot"] / sum(words.values()) <= before["hot"] / sum(before.values()) + 1e-9
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen["mixture"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r["length"] for r in pieces) == total


def test_run_equals_the_stages_and_survives_nothing(spark, folder, tmp_path):
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.count() > 0 and pieces.where("doc_id >= 200 and doc_id < 212").count() == 0
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_on_odd_rows(spark, documents):
    docs = documents()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert set(rows) <= set(docs.collect()) if name == "mixture" else len(rows) <= docs.count()  # the mixture repeats
        if name == "near_copies":  # of equal rows one stays
            assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (1, 2, 3, 4)) == [1, 4, 4]


def test_queries_are_named_by_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_a_small_source_does_not_shrink_the_others(spark):
    sizes = {"large": 300, "middle": 60, "stray": 1}
    rows = [(1000 * k + i, prose(40, 3000 + 1000 * k + i), "en", s, None) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = corpus_pipeline.mixture(spark, docs, "")
    assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect())
    out = collections.Counter((r["source"], r["doc_id"]) for r in kept.collect())
    documents = sum(out.values())
    assert 361 <= documents <= 364  # the budget of 361 documents of 40 words, and less than one more a source
    assert out[("stray", 2000)] == 4 and max(out.values()) == 4
    assert len({d for s, d in out if s == "middle"}) == 60
    large = sum(n for (s, _), n in out.items() if s == "large")
    middle = sum(n for (s, _), n in out.items() if s == "middle")
    assert large >= 300 - 3 * 61 and middle > 60
    shares = [large / documents, middle / documents, 4 / documents]
    before = [n / 361 for n in sizes.values()]
    entropy = lambda x: -sum(p * math.log(p) for p in x)
    assert entropy(shares) > entropy(before)
