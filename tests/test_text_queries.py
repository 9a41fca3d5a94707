import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.catalog import QUERIES
from cellweave.catalog.fixtures import DOC_TERMS
from cellweave.operators import search, textindex


def test_contexts_and_hits_of_all_terms_equal_brute_force(spark, tmp_path):
    texts = [
        "Sand and clay over the shale\nand silt by the gravel and then the schist",
        "The station and\nthe mention",
        "Ouch, " + "and more " * 60 + "the end",
        "nothing",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'a' AS source", "length(text) AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for doc, text in enumerate(texts):
        low = (text or "").lower()
        for category, terms in DOC_TERMS.items():
            for term in terms:
                for k, m in enumerate(re.finditer(term, low)):
                    want.add((doc, category, term, k, low[max(m.start() - 200, 0) : m.end() + 200].replace("\n", " ").strip(" ")))
    assert sum(w[2] == "and.*the" for w in want) == 3
    got = QUERIES["f3_term_contexts_all"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["category"], r["term"], r["k"], r["snippet"]) for r in got} == want and len(got) == len(want)
    first = {w[:3]: w[4] for w in want if w[3] == 0}
    count = {key: sum(w[:3] == key for w in want) for key in first}
    nested = QUERIES["s19_search_hits_all"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["category"], r["term"]): (r["n_contexts"], r["first"]) for r in nested} == {key: (count[key], first[key]) for key in first}


TERMS = {"a": ["aba", "abab", "ab", "a b", "baba.*aba"], "b": ["cab", "zz", "a-b"]}
SCHEMA = "doc_id long, text string, note string"


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def _compare(spark, path, texts, terms):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    textindex.write_index(docs, path, buckets=4, files=3)
    hits = textindex.indexed_hits(spark, path, docs, terms, buckets=4)
    names = ("doc_id", "category", "term", "hits")
    plain = [(i, (t or "").lower()) for i, t in enumerate(texts)]
    want = sorted((i, c, w, n) for i, t in plain for c, ws in terms.items() for w in ws if (n := len(re.findall(w, t))))
    assert _rows(hits, *names) == want
    contexts = textindex.indexed_contexts(spark, path, docs, terms, buckets=4)
    cut = sorted(
        (i, c, w, k, t[max(m.start() - 200, 0) : m.end() + 200].replace("\n", " ").strip(" "))
        for i, t in plain for c, ws in terms.items() for w in ws for k, m in enumerate(re.finditer(w, t))
    )
    assert _rows(contexts, "doc_id", "category", "term", "k", "snippet") == cut


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    texts = [
        "ababababa", "AbA\nBaBa aba", "baba aba baba aba\nbaba\naba", "", None, "a", "ab", "xxab", "\U0001f600ab\U0001f600aba", "a-b " * 500 + "cab",
        "aba baba", "zzz zz", " ab a b ",
    ]
    _compare(spark, str(tmp_path / "index"), texts, TERMS)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet="ab \n", max_size=40), min_size=1, max_size=30))
def test_postings_of_any_texts(spark, tmp_path_factory, texts):
    _compare(spark, str(tmp_path_factory.mktemp("index")), texts, TERMS)


def test_blocks_stay_where_their_texts_are(spark, tmp_path):
    """Writing the index moves no posting, and places are told apart by document within a block."""
    texts = [f"ab{'x' * (i % 7)}ab a b\nbaba {i} aba" * (1 + i % 3) for i in range(300)]
    docs = spark.createDataFrame([(f"d{i}", t, "x") for i, t in enumerate([*texts, "abab"])], "doc_id string, text string, note string")
    path = str(tmp_path / "index")
    textindex.write_index(docs, path, buckets=4, files=3, block=500)
    held = spark.read.parquet(path).select("block", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("part")).distinct()
    parts = held.groupBy("block").agg(F.count("*").alias("parts")).collect()
    assert len(parts) > 6 and {r["parts"] for r in parts} == {1}
    got = textindex.indexed_hits(spark, path, docs, TERMS, buckets=4)
    want = sorted((f"d{i}", c, w, n) for i, t in enumerate([*texts, "abab"]) for c, ws in TERMS.items() for w in ws if (n := len(re.findall(w, t))))
    assert _rows(got, "doc_id", "category", "term", "hits") == want
    places = textindex.literal_places(spark, path, docs, ["ba", "ababa", "baba"], buckets=4)
    assert {(r["doc_id"], r["word"]): r["starts"] for r in places.collect()} == {
        (f"d{i}", w): at for i, t in enumerate([*texts, "abab"]) for w in ["ba", "ababa", "baba"] if (at := [m.start() for m in re.finditer(f"(?={w})", t)])
    }


def test_packed_places_of_far_texts(spark, tmp_path):
    lists = [[0], [65535], [3, 65537, 65538, 131073, 400_000], [70_000, 135_535, 135_536]]
    flat = np.array([x for own in lists for x in own])
    ends, steps = textindex._packed(flat, np.cumsum([0, *(len(own) for own in lists[:-1])]))
    assert [textindex._unpacked(steps.tobytes()[a:b]).tolist() for a, b in zip(ends, ends[1:])] == lists
    texts = ["ab" + "x" * 65533 + "aba" + "y" * 140_000 + "ab zz", "z" * 65536, "cab"]
    _compare(spark, str(tmp_path / "index"), texts, TERMS)


def test_repeated_rows_null_keys_and_empty_tables(spark, tmp_path):
    rows = [(1, "aba", "x"), (1, "aba", "y"), (1, "ABA aba", "x"), (None, "aba", "x"), (2, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    textindex.write_index(docs, path)
    assert _rows(textindex.indexed_hits(spark, path, docs, {"a": ["aba"]}), "doc_id", "hits") == [(1, 1), (1, 2)]
    assert _rows(textindex.indexed_scores(spark, path, docs, {"a": ["aba", "ab"]}, per_term=1), "doc_id", "score", "categories") == [(1, 2, "a"), (1, 2, "a")]
    with pytest.raises(ValueError):
        textindex.indexed_hits(spark, path, docs, {"a": ["a"]})
    assert textindex.indexed_hits(spark, path, docs, {"a": ["nowhere"]}).count() == 0
    assert textindex.indexed_hits(spark, path, docs, {"a": []}).count() == 0
    textindex.write_index(docs.limit(0), path)
    assert textindex.indexed_hits(spark, path, docs.limit(0), TERMS).count() == 0


def test_second_search_reads_postings_not_texts(spark, tmp_path):
    texts = ["gold and iron of the greenstone belt", "shear zone", "iron"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    path = str(tmp_path / "index")
    textindex.write_index(docs, path)
    terms = {c: [t for t in words if ".*" not in t] for c, words in search.SEARCH_TERMS.items()}
    got = textindex.indexed_hits(spark, path, docs.limit(0), terms)
    want = search.term_hits(docs, terms)
    assert _rows(got, "doc_id", "term", "hits") == _rows(want, "doc_id", "term", "hits") != []


def test_contexts_of_a_text_with_many_hits(spark):
    """The work of a text grows with its hits, not with their square."""
    from cellweave.operators import search

    n = 30_000
    docs = spark.createDataFrame([(1, "ab é " * n), (2, None), (None, "x AB\n")], "doc_id long, text string")
    found = search.term_contexts(docs, {"c": ["ab", "é.*ab"]}, per_term=None)
    assert sorted(((r["doc_id"] or 0, r["term"], r["n"]) for r in found.groupBy("doc_id", "term").agg({"*": "count"}).toDF("doc_id", "term", "n").collect())) == [(0, "ab", 1), (1, "ab", n), (1, "é.*ab", 1)]
    one = found.where("doc_id = 1 AND term = 'ab' AND k = 20000").first()
    assert one["snippet"] == ("ab é " * n)[5 * 20000 - 200 : 5 * 20000 + 202].strip(" ")


def test_nested_hits_shuffle_their_snippets_once(spark):
    from cellweave.operators import search

    docs = spark.createDataFrame([(1, "b a ab"), (1, "ab"), (2, "q"), (None, "a")], "doc_id long, text string").coalesce(1)
    nested = search.search_hits(docs, {"one": ["ab", "zz"], "two": ["b", "a"]})
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {r["doc_id"]: {c: [(t["term"], t["contexts"]) for t in ts] for c, ts in r["hits"].items()} for r in nested.collect()}
    assert got == {
        1: {"one": [("ab", ["ab", "b a ab"])], "two": [("b", ["ab", "b a ab", "b a ab"]), ("a", ["ab", "b a ab", "b a ab"])]},
        None: {"two": [("a", ["a"])]},
    }
