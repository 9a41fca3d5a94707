"""Normalisation, tiles, patches, search, run logs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import categories, patches
from cellweave.operators import attribution, normalize, runs, search, tiles


def test_flat_empty_and_outlier_bands(spark):
    rows = [(i, float(i), 5.0, None, None if i == 3 else float(i * i)) for i in range(51)]
    df = spark.createDataFrame(rows, "row int, a double, flat double, empty double, holes double")
    out = normalize.normalize_channels(df, ["a", "flat", "empty", "holes"]).collect()
    assert [out[0]["a"], out[1]["a"], out[50]["a"]] == [0.0, 0.0, 1.0]
    assert {r["flat"] for r in out} == {0.0} and {r["empty"] for r in out} == {None} and out[3]["holes"] is None
    filled = normalize.mean_impute(df, ["holes", "empty"]).collect()
    assert {r["empty"] for r in filled} == {0.0}
    assert abs(filled[3]["holes"] - np.mean([i * i for i in range(51) if i != 3])) < 1e-9
    rgb = normalize.rgb_composite(df, ["empty", "holes"]).collect()
    assert rgb[3]["holes"] == 0.0 and rgb[3]["empty"] == 0.0


def test_validation_uses_its_own_medians_first(spark):
    make = lambda rows: spark.createDataFrame(rows, "a double, b double")
    train, validation = make([(1.0, 10.0), (3.0, 30.0), (None, 20.0)]), make([(100.0, None), (None, None)])
    t, v, p = normalize.median_impute(train, validation, make([(None, None)]), ["a", "b"])
    assert t.collect()[2]["a"] == 2.0
    assert [tuple(r) for r in v.collect()] == [(100.0, 20.0), (100.0, 20.0)]
    assert tuple(p.first()) == (2.0, 20.0)
    fit = normalize.standardize_fit(make([(1.0, 7.0), (3.0, 7.0)]), ["a", "b"])
    assert fit == {"a": (2.0, 1.0), "b": (7.0, 1.0)}


@pytest.mark.parametrize("patch, stride", [(4, 2), (4, 4), (6, 4)])
def test_tiles_equal_slicing(spark, patch, stride):
    rng = np.random.default_rng(0)
    grid = np.where(rng.random((13, 17)) < 0.4, 0.0, rng.random((13, 17)))
    rows = [(r, c, float(grid[r, c])) for r in range(13) for c in range(17)]
    df = spark.createDataFrame(rows, "row bigint, col bigint, a double")
    got = {(r["r"], r["c"]): r["valid"] for r in tiles.tile_valid_fraction(df, ["a"], 13, 17, patch, stride, 0.5).collect()}
    expected = {}
    for r in range(0, 13 - patch + 1, stride):
        for c in range(0, 17 - patch + 1, stride):
            share = (grid[r : r + patch, c : c + patch] != 0).mean()
            if share >= 0.5:
                expected[(r, c)] = share
    assert got == expected
    centres = {(r["row"], r["col"]) for r in tiles.inference_tiles(df, ["a"], 13, 17, 4, 2, 0.0).collect()}
    assert centres == {(r, c) for r in range(2, 11, 2) for c in range(2, 15, 2)}


@pytest.mark.parametrize("patch, stride", [(4, 2), (4, 3)])
def test_overlap_mean_equals_accumulation(spark, patch, stride):
    half = patch // 2
    centres = [(r, c, float(r + 10 * c)) for r in range(half, 13 - half, stride) for c in range(half, 9 - half, stride) if (r + c) % 5]
    total, count = np.zeros((13, 9)), np.zeros((13, 9))
    for r, c, v in centres:
        total[r - half : r + half, c - half : c + half] += v
        count[r - half : r + half, c - half : c + half] += 1
    df = spark.createDataFrame(centres, "row bigint, col bigint, mean double")
    got = tiles.tile_overlap_mean(df, ["mean"], 13, 9, patch, stride).collect()
    assert len(got) == 13 * 9
    for r in got:
        at = (r["row"], r["col"])
        assert r["n_tiles"] == count[at] and (r["mean"] is None if count[at] == 0 else abs(r["mean"] - total[at] / count[at]) < 1e-9)


def test_overlap_mean_off_the_stride_grid(spark):
    df = spark.createDataFrame([(6, 7, 1.0), (8, 8, 3.0)], "row bigint, col bigint, mean double")
    got = {(r["row"], r["col"]): (r["n_tiles"], r["mean"]) for r in tiles.tile_overlap_mean(df, ["mean"], 16, 16, 8, 4).collect()}
    first = {(r, c) for r in range(2, 10) for c in range(3, 11)}
    second = {(r, c) for r in range(4, 12) for c in range(4, 12)}
    for at, (n, mean) in got.items():
        assert n == (at in first) + (at in second)
        assert mean == (None if n == 0 else ((at in first) + 3 * (at in second)) / n)


def test_patch_expressions(spark):
    x = np.arange(32.0).reshape(2, 4, 4)
    df = spark.createDataFrame([(x.ravel().tolist(), x[0].ravel().tolist())], "p array<double>, q array<double>")
    row = df.select(
        patches.patchify(F.col("p"), 4, 2, 2).alias("tokens"),
        patches.rotate90(F.col("q"), 4).alias("r1"), patches.rotate90(F.col("q"), 4, 2).alias("r2"),
        patches.flip_horizontal(F.col("q"), 4).alias("h"), patches.flip_vertical(F.col("q"), 4).alias("v"),
        patches.add_noise(F.col("q"), F.lit(1)).alias("n"),
    ).first()
    tokens = x.reshape(2, 2, 2, 2, 2).transpose(1, 3, 2, 4, 0).reshape(4, 8)  # token, (row, col, channel)
    assert np.array_equal(np.array(row["tokens"]), tokens)
    assert np.array_equal(np.array(row["r1"]).reshape(4, 4), np.rot90(x[0])) and np.array_equal(np.array(row["r2"]).reshape(4, 4), np.rot90(x[0], 2))
    assert np.array_equal(np.array(row["h"]).reshape(4, 4), x[0][:, ::-1]) and np.array_equal(np.array(row["v"]).reshape(4, 4), x[0][::-1])
    assert all(0 <= v <= 1 for v in row["n"])
    rows = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], "id int, q array<double>").select(patches.add_noise(F.col("q"), F.col("id")).alias("n")).collect()
    noise = rows[0]["n"]
    assert noise != rows[1]["n"]  # equal patches get noise of their own
    assert 0.004 < np.std(noise) < 0.02 and abs(np.mean(noise) - 0.5) < 0.01


def test_random_mask_keeps_a_quarter(spark):
    tokens = spark.range(64).select((F.col("id") % 4).alias("t"), F.expr("id div 4").alias("k"))
    got = tiles.random_token_mask(tokens, "t", "k", 16).groupBy("t").agg(F.sum("masked").alias("m")).collect()
    assert [r["m"] for r in got] == [12] * 4


def test_deposit_and_layer_rules(spark):
    names = [" Gold ", "Iron/Gold", "ferrous", "Chromite", "Silver", "magnesite", "lithium", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").select(categories.deposit_type(F.col("t"))).collect()]
    assert got == ["gold", "gold", "iron", "chromite", "polymetallic", "polymetallic", "unknown", "unknown"]
    layers = ["dyke_mine_25k", "Lithology", "mineral_pts", "xyz", "rock_quarry"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in layers], "t string").select(categories.layer_type(F.col("t"))).collect()]
    assert got == ["distance", "categorical", "binary", "distance", "categorical"]
    sheets = spark.createDataFrame([("x/57d/57a.pdf",), ("a/58a",)], "t string").select(categories.map_sheet(F.col("t"))).collect()
    assert [r[0] for r in sheets] == ["57A", "other"]
    assert categories.group_bands("aeromagnetic", "derived") == [f"b{i}" for i in range(8, 15)]


def test_search_scores_and_snippets(spark):
    filler = "x" * 300
    text = f"{filler} Gold and iron near a SHEAR zone\n{filler} gold\nchromite {filler} gold with chromite, shear zone; shear zone, shear zone"
    df = spark.createDataFrame([(1, text), (2, "gold and iron"), (3, "y" * 200)], "doc_id bigint, text string")
    every = {r["doc_id"]: r["score"] for r in search.document_scores(df, search.SEARCH_TERMS).collect()}
    assert every == {1: 7, 2: 1}  # without limits every hit of every document counts
    row = search.document_scores(df, search.SEARCH_TERMS, per_term=3, min_chars=100).collect()
    assert len(row) == 1 and row[0]["doc_id"] == 1
    # 'gold and iron', 'gold.*chromite' and 'chromite.*gold' once (not across lines), 'shear zone' capped at 3
    assert row[0]["score"] == 6 and row[0]["categories"] == "deposit_cooccurrence|structural_control"
    hits = {r["term"]: r["hits"] for r in search.term_hits(df, search.SEARCH_TERMS, min_chars=100).collect()}
    assert hits == {"gold and iron": 1, "gold.*chromite": 1, "chromite.*gold": 1, "shear zone": 4}
    lower = text.lower()
    starts = [i for i in range(len(lower)) if lower.startswith("shear zone", i)]
    for limit in (None, 3):
        found = search.term_contexts(df, {"c": ["shear zone"]}, per_term=limit).orderBy("k").collect()
        assert [r["snippet"] for r in found] == [lower[max(0, s - 200) : s + 210].replace("\n", " ").strip() for s in starts[:limit]]
    nested = search.search_hits(df, search.SEARCH_TERMS, per_term=3, min_chars=100).first()["hits"]
    assert [h["term"] for h in nested["deposit_cooccurrence"]] == ["gold and iron", "gold.*chromite", "chromite.*gold"]
    assert len(nested["structural_control"][0]["contexts"]) == 3


def test_two_phase_search_and_fallback(spark):
    body = "z" * 120
    rows = [(i, f"{body} gold and iron hydrothermal buffer", "57A" if i < 25 else "99X") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sheet = categories.map_sheet(F.col("source"))
    assert search.two_phase_scores(df, search.SEARCH_TERMS, sheet).count() == 25
    assert search.two_phase_scores(df.where("doc_id >= 10"), search.SEARCH_TERMS, sheet).count() == 20
    assert search.two_phase_scores(df.where("doc_id >= 10"), search.SEARCH_TERMS, sheet, others=2).count() == 17
    scores = search.document_scores(df, search.SEARCH_TERMS)
    assert [r["rank"] for r in search.topk_reports(scores, 4).collect()] == [1, 2, 3, 4]
    assert search.topk_reports(scores, 4, "absent", "structural_control").count() == 4
    assert search.topk_reports(scores, 4, "absent", "greenstone_framework").count() == 0


def test_early_stop_and_ablation(spark):
    metric = [0.1, 0.5, 0.505, 0.4, 0.3, 0.2, 0.9]
    logs = spark.createDataFrame([("r", e + 1, m) for e, m in enumerate(metric)], "run string, epoch bigint, m double")
    row = runs.reduce_logs(logs, ["run"], "m", min_delta=0.01, patience=2, freeze_epochs=4).first()
    assert (row["best_metric"], row["best_epoch"], row["stop_epoch"]) == (0.5, 2, 5)
    row = runs.reduce_logs(logs, ["run"], "m", min_delta=0.01, patience=9).first()
    assert (row["best_metric"], row["best_epoch"], row["stop_epoch"]) == (0.9, 7, None)
    best = runs.best_epoch(logs.unionByName(logs.withColumn("epoch", F.col("epoch") + 10)), ["run"], "m").first()
    assert (best["best_epoch"], best["n_epochs"]) == (7, 14)
    table = spark.createDataFrame([(0, "full", 0.43), (0, "geo", 0.3229), (3, "full", 0.966), (3, "geo", 0.9553)], "fold int, variant string, auc double")
    drop = {(r["fold"], r["variant"]): round(r["drop"], 4) for r in runs.ablation_drop(table, "auc").collect()}
    assert drop == {(0, "full"): 0.0, (0, "geo"): 0.1071, (3, "full"): 0.0, (3, "geo"): 0.0107}


def test_integrated_gradients_sum_close_to_the_score_difference(spark):
    df = spark.createDataFrame([(0.8, -0.4)], "a double, b double")
    given = attribution.integrated_gradients(["a", "b"], [1.2, 0.7], -0.3, steps=100)
    row = df.select(*[e.alias(n) for n, e in given.items()]).first()
    sig = lambda z: 1 / (1 + np.exp(-z))
    assert abs(row["a"] + row["b"] - (sig(1.2 * 0.8 - 0.7 * 0.4 - 0.3) - sig(-0.3))) < 2e-3


def test_trace_correlation_of_equal_halves(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(v.tolist(), v.tolist()) for v in rng.normal(size=(50, 4))], "a array<double>, b array<double>")
    assert abs(attribution.trace_correlation(df, "a", "b").first()[0] + 1) < 1e-3
