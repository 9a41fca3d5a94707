import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import evidence, labels


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        label = int(rng.random() < 0.15)
        a = float(np.round(rng.random() + 0.3 * label, 3))
        b = None if rng.random() < 0.1 else float(rng.integers(0, 3))  # mostly ties
        c = float(i % 30 == 0) * 2.0  # too few positive values: median only
        rows.append((i // 30, i % 30, label, a, b, c, None))
    return spark.createDataFrame(rows, "row bigint, col bigint, label bigint, a double, b double, c double, d double")


def _expected(values, labels_):
    known = [(v, y) for v, y in zip(values, labels_) if v is not None]
    n, dep = len(known), sum(y for _, y in known)
    if dep < 10 or n - dep < 100:
        return None
    positive = [v for v, _ in known if v > 0]
    cuts = np.percentile(positive, range(10, 100, 10)) if len(positive) >= 100 else [np.median([v for v, _ in known])]
    best = None
    for t in sorted(set(float(x) for x in cuts)):
        nb = sum(v >= t for v, _ in known)
        if nb < 10 or n - nb < 10:
            continue
        db = max(sum(y for v, y in known if v >= t), 0.5)
        dnb = max(sum(y for v, y in known if v < t), 0.5)
        ndb, ndnb = max(nb - db, 0.5), max(n - nb - dnb, 0.5)
        wp = math.log(db / dep / (ndb / (n - dep)))
        wm = math.log(dnb / dep / (ndnb / (n - dep)))
        if best is None or abs(wp - wm) > abs(best[1] - best[2]):
            best = (t, wp, wm)
    return best


def test_best_thresholds_and_posterior(cells):
    bands = ["a", "b", "c", "d"]
    rows = cells.collect()
    expected = {b: _expected([r[b] for r in rows], [r["label"] for r in rows]) for b in bands}
    expected = {b: e for b, e in expected.items() if e}
    fitted = {r["band"]: r for r in evidence.woe_fit(cells, bands).collect()}
    assert set(fitted) == set(expected) and "d" not in fitted
    for b, (t, wp, wm) in expected.items():
        assert abs(fitted[b]["thr"] - t) < 1e-12
        assert abs(fitted[b]["w_plus"] - wp) < 1e-12 and abs(fitted[b]["w_minus"] - wm) < 1e-12

    scored = evidence.woe_posterior(cells, evidence.woe_fit(cells, bands), "b").collect()
    known = [r for r in rows if r["b"] is not None]
    dep = sum(r["label"] for r in known)
    prior = math.log(dep / (len(known) - dep) + 1e-8)
    for r in scored:
        logit = prior + sum((wp if r[b] >= t else wm) for b, (t, wp, wm) in expected.items() if r[b] is not None)
        assert 0 < r["posterior"] < 1 and abs(r["posterior"] - 1 / (1 + math.exp(-logit))) < 1e-12


def test_too_few_positives_give_no_weights(cells):
    rare = cells.withColumn("label", F.when(F.col("row") == 0, F.col("label")).otherwise(0))
    assert evidence.woe_fit(rare, ["a"]).count() == 0


def test_threshold_classes_without_cells(spark):
    rows = [(0, i, int(i % 4 == 0), float(10 if i % 2 else 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "row bigint, col bigint, label bigint, a double")
    got = evidence.woe_contingency(df, ["a"], {"a": [1.0, 4.0, 5.0, 10.0]}).orderBy("thr").collect()
    assert [(r["thr"], r["n_b"]) for r in got] == [(4.0, 200.0), (5.0, 200.0), (10.0, 200.0)]


def test_folds_are_disjoint_and_keep_the_gap(spark):
    strips = labels.fold_strips(2500, 5, 400)
    cells = spark.range(2500).select(F.lit(0).cast("bigint").alias("row"), F.col("id").alias("col"), (F.col("id") % 7 == 0).cast("bigint").alias("label"))
    used = labels.spatial_folds(cells, strips)
    for fold in range(5):
        parts = {region: [r["col"] for r in used.where(F.col("fold") == fold).where(F.col("region") == region).collect()] for region in ("test", "train")}
        assert len(parts["test"]) == 500
        gaps = [min(abs(c - min(parts["test"])), abs(c - max(parts["test"]))) for c in parts["train"]]
        assert not set(parts["test"]) & set(parts["train"]) and min(gaps) > 400
    masks = labels.fold_masks(cells, strips)
    counts = {(r["fold"], r["kind"]): r["count"] for r in masks.groupBy("fold", "kind").count().collect()}
    for r in labels.fold_counts(cells, strips).collect():
        assert counts[(r["fold"], "test_pos")] == r["n_test_pos"]
        assert counts[(r["fold"], "train_pos")] == r["n_train_pos"] and counts[(r["fold"], "train_unl")] == r["n_train_unl"]


def test_samples(spark):
    cells = spark.range(2000).select(F.expr("id div 50").alias("row"), (F.col("id") % 50).alias("col"), (F.col("id") % 40 == 0).cast("bigint").alias("label"))
    for options in ({}, {"task_rows": 100}):
        got = labels.stratified_sample(cells, 5, 42, **options)
        assert got.where("label = 1").count() == 50 and got.where("label = 0").count() == 250
    assert labels.stratified_sample(cells, 5, 42, cap=10).count() == 60
    assert labels.stratified_sample(cells, 500, 42).count() == 2000
    assert set(map(tuple, got.collect())) != set(map(tuple, labels.stratified_sample(cells, 5, 43).collect()))
    weights = labels.with_weights(got).groupBy("label").agg(F.max("weight").alias("w")).collect()
    assert {r["label"]: r["w"] for r in weights} == {1: 1.0, 0: 0.1}


def test_seeds_separate_cells_that_once_went_together(spark):
    cells = spark.createDataFrame([(r, c) for r in range(40) for c in range(40)], "row bigint, col bigint")
    keys = {seed: {(r["row"], r["col"]): r["k"] for r in cells.select("row", "col", labels.sampling_key(seed).alias("k")).collect()} for seed in (1, 2)}
    assert all(0 <= k < labels.KEY_RANGE for k in keys[1].values())
    same = {}
    for at, k in keys[1].items():
        same.setdefault(k, []).append(at)
    assert all(keys[2][a] != keys[2][b] for group in same.values() for a, b in zip(group, group[1:], strict=False))
    order = [sorted(keys[s], key=keys[s].get) for s in (1, 2)]
    assert len(set(order[0][:200]) & set(order[1][:200])) < 60


def test_split_and_fold_exclusion(spark):
    tiles = spark.range(95).select(F.col("id").alias("r"), (F.col("id") % 19 * 4).alias("c"))
    split = labels.random_split(tiles, 42, "r", "c")
    assert split.where("split = 'val'").count() == 9 and split.count() == 95
    assert labels.random_split(tiles.limit(3), 1, "r", "c").where("split = 'val'").count() == 1
    positives = spark.createDataFrame([(1, 20), (2, 40)], "row bigint, col bigint")
    kept = {r["c"] for r in labels.exclude_fold_tiles(tiles, positives, 8).collect()}
    assert kept == {c for c in range(0, 76, 4) if not 20 <= c + 4 <= 40}  # both ends excluded
    assert labels.exclude_fold_tiles(tiles, positives.limit(0), 8).count() == 95
    wider = {r["c"] for r in labels.exclude_fold_tiles(tiles, positives, 8, buffer_cols=8).collect()}
    assert wider == {c for c in range(0, 76, 4) if not 12 <= c + 4 <= 48}


def test_a_hot_item_is_drawn_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(labels, "STRETCH", 50)
    items = spark.range(30).select(F.col("id"), F.when(F.col("id") == 4, 100.0).otherwise(1.0).alias("w"))
    got = labels.weighted_draw(items, "w", "id", n=4000).groupBy("id").count().collect()
    counts = {r["id"]: r["count"] for r in got}
    assert sum(counts.values()) == 4000 and abs(counts[4] / 4000 - 100 / 129) < 0.03


def test_weighted_draw_follows_the_weights(spark):
    items = spark.range(40).select(F.col("id"), F.when(F.col("id") == 7, 30.0).otherwise(1.0).alias("w"))
    for options in ({}, {"task_rows": 10}):
        got = labels.weighted_draw(items, "w", "id", n=6000, **options).groupBy("id").count().collect()
        counts = {r["id"]: r["count"] for r in got}
        assert sum(counts.values()) == 6000
        assert abs(counts[7] / 6000 - 30 / 69) < 0.03
        assert all(abs(counts[i] / 6000 - 1 / 69) < 0.01 for i in range(40) if i != 7)


def test_stratified_sample_counts_few_keys_and_keeps_the_order_of_the_hash(spark, monkeypatch):
    import hashlib

    seen = []
    inner = labels.smallest_by_key
    monkeypatch.setattr(labels, "smallest_by_key", lambda df, *a, **o: seen.append(df.select("_key").distinct().count()) or inner(df, *a, **o))
    cells = spark.range(20_000).select((F.col("id") / 100).cast("bigint").alias("row"), (F.col("id") % 100).alias("col"), (F.col("id") % 5 == 0).cast("bigint").alias("label"), (F.col("id") % 2).alias("g"))
    got = labels.stratified_sample(cells, 1.5, F.lit(3) + F.col("g"), 700, ["g"]).collect()
    rows = cells.collect()
    for g in (0, 1):
        order = sorted((r for r in rows if r["g"] == g), key=lambda r: hashlib.md5(f"{r['row']}-{r['col']}-{3 + g}".encode()).hexdigest())
        positive = [r for r in order if r["label"] == 1][:700]
        unlabeled = [r for r in order if r["label"] == 0][: int(len(positive) * 1.5)]
        assert {(r["row"], r["col"]) for r in got if r["g"] == g} == {(r["row"], r["col"]) for r in positive + unlabeled}
    assert seen[0] <= labels.SAMPLE_KEYS == 4096
