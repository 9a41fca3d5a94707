import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.scalars import linear_bucket, linspace_values, threshold_bucket
from cellweave.operators import metrics


def _scored(spark, seed=2, n=300):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(np.clip(0.3 * y + rng.random(n) * 0.8, 0, 1), 2)  # ties
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double"), y, s


def _average_precision(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - last) * y[hit].mean()
        last = recall
    return total


def _mann_whitney(y, s):
    p, q = s[y == 1], s[y == 0]
    return np.mean((p[:, None] > q[None, :]) + 0.5 * (p[:, None] == q[None, :]))


@pytest.mark.parametrize("options", [{}, {"task_rows": 12}])
def test_ranking_metrics(spark, options):
    df, y, s = _scored(spark)
    assert abs(metrics.auc_pr(df, **options).first()[0] - _average_precision(y, s)) < 1e-12
    assert abs(metrics.auc_roc(df, **options).first()[0] - _mann_whitney(y, s)) < 1e-12
    bent = df.withColumn("score", F.exp(F.col("score") * 3))  # monotone map
    assert abs(metrics.auc_roc(bent, **options).first()[0] - _mann_whitney(y, s)) < 1e-12


def test_sweep_and_best_threshold(spark):
    df, y, s = _scored(spark, 4)
    best = (0.5, 0.0, 0.0)
    for t in np.linspace(0.01, 0.99, 50):
        pred = s >= t
        if not pred.any():
            continue
        tp, fp, fn, tn = (pred & (y == 1)).sum(), (pred & (y == 0)).sum(), (~pred & (y == 1)).sum(), (~pred & (y == 0)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn)
        d = math.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        if f1 > best[1]:
            best = (t, f1, (tp * tn - fp * fn) / d if d else 0.0)
    got = metrics.best_threshold(metrics.threshold_sweep(df)).first()
    assert abs(got["threshold"] - best[0]) < 1e-12 and abs(got["f1"] - best[1]) < 1e-12 and abs(got["mcc"] - best[2]) < 1e-12
    row = metrics.evaluate(df).first()
    assert abs(row["f1"] - best[1]) < 1e-12 and abs(row["auc_pr"] - _average_precision(y, s)) < 1e-12


def test_one_class_gives_zeros(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.7)], "label int, score double")
    row = metrics.evaluate(df).first()
    assert (row["auc_pr"], row["auc_roc"], row["f1"], row["threshold"]) == (0.0, 0.0, 0.0, 0.5)


def test_linear_bucket_is_exact_on_the_thresholds(spark):
    cuts = linspace_values(0.01, 0.99, 50)
    values = cuts + [np.nextafter(c, 0) for c in cuts] + [-3.0, 0.0, 1.0, 7.5]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for r in df.select("v", linear_bucket(F.col("v"), 0.01, 0.99, 50).alias("a"), threshold_bucket(F.col("v"), cuts).alias("b")).collect():
        assert r["a"] == r["b"] == sum(r["v"] >= c for c in cuts)


def test_chi_squared_tail(spark):
    rows = [(4.785, 2, 0.0914), (3.841459, 1, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (11.0705, 5, 0.05), (0.0, 3, 1.0)]
    df = spark.createDataFrame([(h, k) for h, k, _ in rows], "h double, k int")
    got = [r[0] for r in df.select(metrics._chi2_upper("h", "k")).collect()]
    assert all(abs(g - p) < 5e-5 for g, (_, _, p) in zip(got, rows))


@pytest.mark.parametrize("options", [{}, {"task_rows": 9}])
def test_kruskal_needs_three_values_and_two_groups(spark, options):
    data = {"a": [1, 2, 2, 3, 9], "b": [4, 5, 5, 6, 2], "c": [7, 8]}
    rows = [(g, "K", float(v)) for g, vs in data.items() for v in vs] + [("a", "U", 1.0), ("a", "U", 2.0), ("a", "U", 3.0)]
    got = metrics.kruskal_wallis(spark.createDataFrame(rows, "g string, ch string, v double"), "g", "ch", "v", **options).collect()
    pooled = np.array(data["a"] + data["b"], dtype=float)
    ranks = np.array([(pooled < v).sum() + ((pooled == v).sum() + 1) / 2 for v in pooled])
    n = len(pooled)
    h = 12 / (n * (n + 1)) * (ranks[:5].sum() ** 2 / 5 + ranks[5:].sum() ** 2 / 5) - 3 * (n + 1)
    h /= 1 - sum((pooled == v).sum() ** 3 - (pooled == v).sum() for v in set(pooled)) / (n**3 - n)
    assert len(got) == 1 and abs(got[0]["h"] - h) < 1e-12 and got[0]["df"] == 1
    assert abs(got[0]["p"] - math.erfc(math.sqrt(h / 2))) < 1e-12


def test_loss_and_summary(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (0, -700.0, 0.1), (0, 700.0, 0.1)], "y int, x double, w double")
    loss = df.agg(metrics.pu_bce(F.col("y"), F.col("x"), F.col("w"))).first()[0]
    assert abs(loss - (math.log1p(math.exp(-2)) + 0.0 + 70.0) / 3) < 1e-12
    five = spark.createDataFrame([(v,) for v in (0.4016, 0.5791, 0.8326, 0.9723, 0.8006)], "m double")
    row = metrics.fold_summary(five, ["m"]).first()
    assert round(row["mean_m"], 4) == 0.7172 or round(row["mean_m"], 4) == 0.7173
    assert round(row["std_m"], 4) == 0.2020


def test_success_rate_and_interpolation(spark):
    rng = np.random.default_rng(9)
    cells, occ = np.round(rng.random(500), 2), np.round(rng.random(40) ** 0.5, 2)
    make = lambda v: spark.createDataFrame([(float(x),) for x in v], "score double")
    got = metrics.success_rate_curve(make(cells), make(occ)).orderBy("step").collect()
    cuts = np.percentile(cells, np.linspace(100, 0, 200))
    assert np.allclose([r["threshold"] for r in got], cuts)
    for r in got:
        assert abs(r["pct_area"] - 100 * (cells >= r["threshold"]).mean()) < 1e-9
        assert abs(r["pct_occ"] - 100 * (occ >= r["threshold"]).mean()) < 1e-9
    curve = spark.createDataFrame([(0, r["pct_area"], r["pct_occ"]) for r in got], "fold int, a double, o double")
    even = metrics.interpolate_curves(curve, "fold", "a", "o").orderBy("step").collect()
    expected = np.interp(np.linspace(0, 100, 200), [r["pct_area"] for r in got], [r["pct_occ"] for r in got])
    assert np.allclose([r["y"] for r in even], expected)
    assert metrics.success_rate_curve(make(cells), make(occ).where("score > 9")).count() == 0
    assert metrics.mean_curve(curve, "fold", "a", "o").count() == 200


def test_components_and_tiers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ np.array([[1, 0.8, 0.1], [0, 1, 0.3], [0, 0, 1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "k double, u double, th double")
    fit = metrics.principal_components(df, ["k", "u", "th"])
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T, ddof=0))[::-1]
    assert np.allclose(fit["ratio"], values[:2] / values.sum())
    scores = np.array([(r["pc1"], r["pc2"]) for r in metrics.project_components(df, fit).collect()])
    assert np.allclose(scores.var(0), values[:2])
    assert metrics.principal_components(df.limit(9), ["k", "u", "th"]) is None

    t = spark.createDataFrame([(0.3, 0.1), (0.4, 0.3), (0.05, 0.1), (0.1, 0.9), (0.2, 0.1), (None, 0.1)], "p double, u double")
    got = [r["tier"] for r in metrics.exploration_tiers(t, "p", "u").collect()]
    assert got == [1, 2, 3, 4, None, None]
    none_high = metrics.exploration_tiers(t.where("p < 0.25"), "p", "u").collect()
    assert [r["tier"] for r in none_high] == [4, 4, None]
    assert {r["tier"]: r["area_km2"] for r in metrics.tier_area(metrics.exploration_tiers(t, "p", "u")).collect()}[1] == 0.0025
