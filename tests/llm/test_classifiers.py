import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm.quality import LABELLERS, QualityModel, classify_quality, code_of, decode, fit_labels, fit_linear, fit_quality, measure, votes
from cellweave.llm.toxicity import Chain, Hashed, Linear, fit_chain, score_toxicity, train_chain
from tests.llm.conftest import WORDS, prose


def junk(seed):
    rng = random.Random(seed)
    words = prose(60, seed).split()
    kind = seed % 4
    if kind == 0:
        return " ".join([rng.choice(words)] * 60)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join(w.upper() + "!!" for w in words)


@pytest.fixture
def mixed(spark):
    rows = [(i, prose(40 + i % 50, i) if i % 5 else junk(i // 5), i % 5 > 0) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, good boolean")


def test_quality_on_held_out_texts(spark, mixed):
    model = fit_quality(mixed.where("doc_id < 250"))
    got = classify_quality(mixed.where("doc_id >= 250"), model)
    assert got.where("good <> quality_keep").count() <= 2
    assert got.columns[:3] == mixed.columns


def test_quality_of_odd_rows(spark, documents, nothing):
    docs = documents().withColumn("quality_score", F.lit("clash"))
    got = classify_quality(docs)
    assert got.count() == docs.count() and dict(got.dtypes)["quality_score"] == "double"
    blank = got.where("doc_id in (5, 6, 7)").collect()
    assert [(r["quality_score"], r["quality_keep"]) for r in blank] == [(0.0, False)] * 3
    assert len({r["quality_score"] for r in got.where("doc_id in (1, 2)").collect()}) == 1
    assert classify_quality(nothing).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    n, right = 20_000, np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    good = rng.random(n) < 0.8
    correct = rng.random((n, 5)) < right
    given = np.where(correct == good[:, None], 2, 0)
    given[rng.random((n, 5)) < 0.2] = 1
    pattern, times = np.unique(given, axis=0, return_counts=True)
    model = fit_labels(pattern, times.astype(float))
    assert np.abs(model.accuracies() - right).max() < 0.03 and abs(model.prior - 0.8) < 0.03
    assert ((model.posterior(given) > 0.5) == good).mean() > 0.95


def test_codes_round_trip():
    given = [votes(measure(t)[0]) for t in (prose(40, 1), junk(1), "", "hi")]
    codes = np.array([code_of(v) for v in given])
    assert decode(codes).tolist() == [list(v) for v in given] and len(LABELLERS) == len(given[0])
    w, b = fit_linear(np.zeros((0, 4), dtype=np.float32), np.zeros(0))
    assert QualityModel(fit_labels(np.zeros((0, 3), dtype=int), np.zeros(0)), w, b).score(np.zeros(4)) == 0.5


def toxic_rows():
    rows = []
    for i in range(600):
        text, kind = prose(30, 1000 + i).replace("\n", " ").split(" "), i % 6
        if kind == 0:
            text[i % 20] = ["dolt", "oaf", "fool"][i % 3]
        elif kind == 1:
            text[i % 20] = "zorv" + WORDS[i % 16]  # coded: a stem with changing endings
        rows.append((i, " ".join(text), int(kind < 2)))
    return rows


def categories():
    bad, open_ = F.col("toxic") == 1, F.col("text").rlike("dolt|oaf|fool")
    return {"insult": bad & open_, "coded": bad & ~open_, "toxic": bad}



def test_chain_on_held_out_texts(spark):
    rows = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    chain, held, y = fit_chain(docs, labels.where("doc_id < 400").union(labels.where("doc_id < 40")), ["toxic"], categories(), bits=14)
    assert held.shape == y.shape == (400, 3) and ((held > 0.5) == y).mean() > 0.95
    got = score_toxicity(docs.where("doc_id >= 400"), chain).join(labels.withColumnRenamed("toxic", "truth"), "doc_id")
    assert got.where("(truth = 1) <> toxic").count() <= 6
    assert [c for c in got.columns if c.startswith("p_")] == ["p_insult", "p_coded", "p_toxic"]


def test_toxicity_of_odd_rows(spark, documents, nothing):
    docs = documents().withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (10, None), (None, 1), (8, 0), (77, 1)], "doc_id long, toxic int")
    chain, held, y = fit_chain(docs, labels, ["toxic"], {"toxic": F.col("toxic") == 1}, bits=10)
    assert len(y) == 3
    got = score_toxicity(docs, chain)
    assert got.count() == docs.count() and got.where("p_toxic is null").count() == 0
    assert len({r["p_toxic"] for r in got.where("doc_id in (5, 6, 7)").collect()}) == 1
    assert score_toxicity(nothing, chain).count() == 0
    empty, _, _ = fit_chain(nothing, labels, ["toxic"], {"toxic": F.col("toxic") == 1}, bits=10)
    assert score_toxicity(docs, empty).count() == docs.count()


def test_later_models_see_out_of_fold_probabilities():
    hashed = Hashed(12)
    found = [hashed(t) for _, t, _ in toxic_rows()]
    y = np.array([[r[0] % 6 == 0, r[2]] for r in toxic_rows()], dtype=float)
    fold = np.arange(len(found)) // 6 % 3
    chain, held = train_chain(found, y, fold, ["insult", "toxic"], 12)
    assert chain.models[0].chain.shape == (0,) and chain.models[1].chain.shape == (1,) and chain.models[1].chain[0] > 0
    again, same = train_chain(found, y, fold, ["insult"], 12)
    assert np.allclose(held[:, 0], same[:, 0])
    one = Linear(np.array([3, 9], dtype=np.int32), np.array([1.0, 2.0]), np.zeros(0), 0.0)
    assert one.score(np.array([1, 9, 11], dtype=np.int32), np.zeros(0)) == pytest.approx(1 / (1 + np.exp(-2)))
    assert Chain(("a",), (one,), 12).predict(np.array([], dtype=np.int32)) == [0.5]
