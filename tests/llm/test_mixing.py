import math
import random

import pytest

from cellweave.llm.common import with_identity
from cellweave.llm.mixing import Mixture, mix, realise, temperature_weights, word_count


def table(spark, sizes, tokens=10):
    rows = [(k * 100_000 + i, s, f"t{k} " * (tokens + i % 3)) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame([(i, s, t, "clash") for i, s, t in rows], "doc_id long, source string, text string, tokens string")


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def totals(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, tokens long")


def test_exponent_meets_the_entropy(spark):
    sizes = {"a": 9000, "b": 600, "c": 300, None: 100}
    found = temperature_weights(totals(spark, sizes), entropy=0.8, repeats=100)
    weights = {r["source"]: r["weight"] for r in found.sources.collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9
    assert abs(entropy(weights.values()) - 0.8 * math.log(4)) < 1e-4
    z = sum((n / 10_000) ** found.exponent for n in sizes.values())
    assert all(abs(weights[s] - (n / 10_000) ** found.exponent / z) < 1e-9 for s, n in sizes.items())


def test_repetition_limit_wins(spark):
    found = temperature_weights(totals(spark, {"a": 9000, "b": 600, "c": 300, "d": 100}), entropy=1.0, repeats=3)
    assert 2.99 < max(r["repeats"] for r in found.sources.collect()) <= 3.001
    assert found.budget == 10_000
    small = temperature_weights(totals(spark, {"a": 90, "b": 10}), entropy=1.0, repeats=2, budget=1000)
    assert small.exponent == 1 and small.budget == 200


def test_shrink_keeps_the_entropy(spark):
    found = temperature_weights(totals(spark, {"a": 9000, "b": 600, "c": 400}), entropy=0.9, repeats=1, shrink=True)
    rows = found.sources.collect()
    assert abs(entropy([r["weight"] for r in rows]) - 0.9 * math.log(3)) < 1e-4
    assert max(r["repeats"] for r in rows) <= 1.0001 and found.budget < 10_000


def test_blocks_realise_the_budgets(spark):
    docs = table(spark, {"a": 900, "b": 60, "c": 40, None: 20})
    emitted, mixture = mix(docs, entropy=0.9, repeats=4, block_docs=50)
    rows = emitted.collect()
    plan = {r["source"]: r for r in mixture.sources.collect()}
    for source, p in plan.items():
        mine = [r for r in rows if r["source"] == source]
        got = sum(r["tokens"] for r in mine)
        assert p["budget"] - 0.5 <= got < p["budget"] + 12
        mine.sort(key=lambda r: (r["epoch"], r["block_rank"], r["rank"]))
        assert [r["start"] for r in mine][:1] == [0]
        assert all(a["start"] + a["tokens"] == b["start"] for a, b in zip(mine, mine[1:], strict=False))
        for e in range(int(p["budget"] // p["tokens"])):
            assert len({r["doc_id"] for r in mine if r["epoch"] == e}) == p["docs"]
    orders = [[r["doc_id"] for r in sorted((r for r in rows if r["source"] == "c" and r["epoch"] == e), key=lambda r: (r["block_rank"], r["rank"]))] for e in (0, 1)]
    assert orders[0] != orders[1]


def test_odd_rows(spark, documents, nothing):
    docs = documents()
    emitted, mixture = mix(docs, entropy=None, repeats=1)
    assert mixture.exponent == 1
    assert sorted(str(r["doc_id"]) for r in emitted.collect()) == sorted(str(r["doc_id"]) for r in docs.collect())
    want = {(r["doc_id"], len((r["text"] or "").split())) for r in docs.collect() if r["doc_id"] in (1, 5, 6, 7, 8, 10)}
    assert want <= {(r["doc_id"], r["tokens"]) for r in emitted.collect()}
    emitted, mixture = mix(nothing)
    assert emitted.count() == 0 and mixture.sources.count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, "b", "")], "doc_id long, source string, text string")
    assert mix(blank)[0].count() == 2
    assert docs.select(word_count(docs["text"]).alias("n")).where("n is null").count() == 0


def test_main_path_has_no_python(documents):
    plan = mix(documents())[0]._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def by_loop(tokens, target, repeats, budget):
    """Weights by halving an interval of exponents, the entropy first and the repetition limit on top."""
    used = {s: n for s, n in tokens.items() if n}
    total = sum(used.values())

    def weights(x):
        powers = {s: (n / total) ** x for s, n in used.items()}
        return {s: p / sum(powers.values()) for s, p in powers.items()}

    def halve(fits, largest):
        low, high = 0.0, 1.0
        if fits(1.0 if largest else 0.0):
            return 1.0 if largest else 0.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if fits(middle) == largest else (low, middle)
        return low if largest else high

    x = 1.0
    if len(used) > 1:
        x = halve(lambda e: entropy(weights(e).values()) >= target * math.log(len(used)), True)
        x = max(x, halve(lambda e: max(weights(e)[s] * budget / n for s, n in used.items()) <= repeats, False))
    return weights(x)


@pytest.mark.parametrize("seed", range(3))
def test_emitted_documents_equal_a_plain_loop(spark, seed):
    """One source has a single long text, one has a long text among many short ones, one is tiny."""
    rng = random.Random(seed)
    sizes = {"one": [1000], "mixed": [1500, *[rng.randrange(1, 20) for _ in range(200)]], "tiny": [3, 2], "big": [rng.randrange(5, 60) for _ in range(80)], None: [40, 0, 7]}
    rows = [(k * 1000 + i, s, "w " * n) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    emitted, mixture = mix(docs, entropy=0.85, repeats=4.0, block_docs=30, seed=seed)
    tokens = {s: sum(ns) for s, ns in sizes.items()}
    plan = {r["source"]: r for r in mixture.sources.collect()}
    for source, weight in by_loop(tokens, 0.85, 4.0, sum(tokens.values())).items():
        assert abs(plan[source]["weight"] - weight) < 1e-5
        assert abs(plan[source]["budget"] - weight * sum(tokens.values())) < 0.5
    # The whole order of every source: the same permutations with budgets that take whole epochs.
    wide = mixture.sources.selectExpr("source", "docs", "tokens", "weight", "cast(ceil(budget / tokens) * tokens as double) as budget", "repeats")
    base = with_identity(docs).select("doc_id", "source", "_r1", "_r2", word_count(docs["text"]).alias("tokens"))
    every, found = realise(base, Mixture(mixture.exponent, mixture.budget, wide), 30, seed).collect(), emitted.collect()
    for source, p in plan.items():
        stream = sorted((r for r in every if r["source"] == source), key=lambda r: (r["epoch"], r["block_rank"], r["rank"]))
        want, total = [], 0
        for r in stream:
            if total >= p["budget"] - 0.5:
                break
            want.append((r["epoch"], r["doc_id"], total))
            total += r["tokens"]
        got = sorted((r for r in found if r["source"] == source), key=lambda r: (r["epoch"], r["block_rank"], r["rank"]))
        assert [(r["epoch"], r["doc_id"], r["start"]) for r in got] == want
        assert p["budget"] - 0.5 <= total < p["budget"] + max(sizes[source])
