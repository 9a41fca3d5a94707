import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import labels, metrics, models
from cellweave.operators.logistic import fit_logistic_groups
from cellweave.plans import baselines


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        y = int(rng.random() < 0.2)
        rows.append((i // 100, i % 100, y, float(rng.normal() + 1.5 * y), float(rng.normal())))
    return spark.createDataFrame(rows, "row bigint, col bigint, label bigint, a double, b double").cache()


def test_logistic_forest_and_map(spark, cells):
    train = labels.with_weights(labels.stratified_sample(cells, 3))
    terms = models.fit_logistic(train, ["a", "b"])
    assert terms[1] > 0.5 and abs(terms[2]) < 0.3
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(train.withColumn("label", F.col("label").cast("double")))
    library = LogisticRegression(featuresCol="x", weightCol="weight", regParam=1e-4, standardization=False, tol=1e-12, maxIter=200).fit(ready)
    assert np.allclose(terms, [library.intercept, *library.coefficients], atol=1e-5)

    forest = models.fit_forest(train, ["a", "b"], trees=8, depth=5)
    top = models.forest_importance(forest, ["a", "b"], spark).orderBy("rank").collect()
    assert [r["feature"] for r in top] == ["a", "b"] and abs(sum(r["importance"] for r in top) - 1) < 1e-9
    assert models.top_features(spark.createDataFrame(top), 1).first()["feature"] == "a"
    known = F.col("a").isNotNull() & (F.col("row") > 0)
    image = models.pixel_map(cells, forest, known)
    assert image.count() == 3000 and image.where("score >= 0").count() == cells.where(known).count()


def test_ensemble_spread(spark, cells):
    ensemble = models.fit_ensemble(cells, ["a", "b"], passes=3, ratio=1.0)
    assert len({tuple(terms) for terms in ensemble}) == 3
    got = models.ensemble_uncertainty(cells, ["a", "b"], ensemble, ["row", "col"])
    row = got.agg(F.count("*").alias("n"), F.min("std").alias("s"), F.max("mean").alias("m")).first()
    assert row["n"] == 3000 and row["s"] >= 0 and row["m"] <= 1


def test_cross_validation_and_ablation(cells):
    strips = labels.fold_strips(100, 5, 5)[:2]
    metrics = baselines.spatial_cv(cells, ["a", "b"], strips, "logistic")
    rows = metrics.collect()
    assert [r["fold"] for r in rows] == [0, 1] and all(r["auc_roc"] > 0.75 for r in rows)
    assert abs(baselines.cv_summary(metrics).first()["mean_auc_roc"] - np.mean([r["auc_roc"] for r in rows])) < 1e-12
    dropped = baselines.channel_ablation(cells, {"full": ["a", "b"], "no_a": ["b"]}, strips[:1]).where("variant = 'no_a'").first()
    assert dropped["drop"] > 0.1


def test_mapped_cells_are_prepared_like_the_training_rows(cells):
    """A forest fitted on scaled rows must see scaled cells: the map ranks as the model does on its own rows."""
    wide = cells.withColumns({"a": F.col("a") * 1000 + 5e5, "b": F.col("b") - 300}).cache()
    samples = baselines.fold_samples(wide, ["a", "b"], labels.fold_strips(100, 5, 5)[:1], cap=300)
    fold = baselines.fold_tables(samples, ["a", "b"], [0])[0]
    model = models.fit_forest(fold.train, ["a", "b"], trees=10, depth=5)
    scored = models.pixel_map(fold.apply(wide), model, F.lit(True)).join(wide.select("row", "col", "label"), ["row", "col"])
    assert metrics.auc_roc(scored).first()["auc_roc"] > 0.75
    assert scored.select("score").distinct().count() > 100


def test_one_class_gives_zeros(cells):
    one = cells.select(F.col("label"), F.lit(0.9).alias("score"))
    for label in (0, 1):
        row = metrics.evaluate(one.withColumn("label", F.lit(label))).first()
        assert (row["threshold"], row["f1"], row["mcc"]) == (0.5, 0.0, 0.0)
    two = one.withColumns({"g": F.col("label"), "label": F.lit(1)}).union(one.withColumns({"g": F.lit(5), "label": F.col("label")}).select("label", "score", "g"))
    rows = {r["g"]: r["f1"] for r in metrics.evaluate(two, by=["g"]).collect()}
    assert rows[0] == rows[1] == 0 and rows[5] > 0


def newton(x, y, w, l2, active):
    """Plain Newton steps for one model."""
    x = np.column_stack([np.ones(len(x)), x])[:, active]
    terms, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[0] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ terms)))
        g = x.T @ (w * (p - y)) / w.sum() + penalty * terms
        h = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + np.diag(penalty)
        terms = terms - np.linalg.solve(h, g)
    return terms


def test_grouped_newton_equals_one_fit_a_group(spark):
    rng = np.random.default_rng(9)
    x, g = rng.normal(size=(900, 3)), rng.integers(0, 3, 900)
    y = (rng.random(900) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.2] + g - 1)))).astype(float)
    w = rng.choice([0.1, 1.0, 2.0], 900)
    rows = [(None if k == 2 else int(k), *map(float, v), int(c), float(u)) for k, v, c, u in zip(g, x, y, w, strict=True)]
    rows += [(0, None, 0.0, 0.0, 1, 1.0), (0, 1.0, 1.0, 1.0, None, 1.0), (0, 9.0, 9.0, 9.0, 0, 0.0)]
    table = spark.createDataFrame(rows, "fold bigint, a double, b double, c double, label bigint, weight double")
    variants = {"full": ["a", "b", "c"], "no_b": ["a", "c"]}
    fitted = fit_logistic_groups(table, ["a", "b", "c"], ["fold"], variants, l2=0.01)
    assert len(fitted) == 6
    for (fold, name), terms in fitted.items():
        mine, active = g == (2 if fold is None else fold), [0, 1, 2, 3] if name == "full" else [0, 1, 3]
        assert np.allclose(np.array(terms)[active], newton(x[mine], y[mine], w[mine], 0.01, active), atol=1e-8)
        assert name == "full" or terms[2] == 0
    assert fit_logistic_groups(table.limit(0), ["a"], ["fold"]) == {}
    apart = spark.createDataFrame([(float(i), int(i > 5), 1.0) for i in range(10)], "a double, label bigint, weight double")
    bias, slope = fit_logistic_groups(apart, ["a"], l2=1e-6)[("full",)]  # separable: only the penalty holds it
    assert slope > 1 and abs(bias + 5.5 * slope) < slope


def test_a_forest_in_parts_equals_one_fit(cells, monkeypatch):
    train = labels.with_weights(labels.stratified_sample(cells, 3))
    auc = {}
    for trees in (10, 120):
        monkeypatch.setattr(models, "PART_TREES", trees)
        forest = models.fit_forest(train, ["a", "b"], trees=120, depth=30)
        assert len(forest.parts) == 120 // trees and sum(forest.trees) == 120
        assert sum(part.getNumTrees for part in forest.parts) == 120
        auc[trees] = metrics.auc_roc(models.score(forest, cells)).first()["auc_roc"]
    assert abs(auc[10] - auc[120]) < 0.01


def test_depth_maps_take_members_as_weights_and_bias(spark):
    from cellweave.plans.maps import depth_maps

    tiles = spark.createDataFrame([(2, 2, 0.5, 1.0), (2, 4, -1.0, 0.25)], "row long, col long, a double, b double")
    ensembles = {"near": [([1.0, -2.0], 0.5), ([0.0, 1.0], -0.5)], "far": [([0.25, 0.25], 0.0), ([1.0, 0.0], 1.0)]}
    out = {(r["row"], r["col"]): r for r in depth_maps(tiles, ["a", "b"], ensembles, 4, 6, 4, 2).collect()}

    def member(weights, bias, a, b):
        return 1 / (1 + np.exp(-(weights[0] * a + weights[1] * b + bias)))

    means = {}
    for depth, members in ensembles.items():
        p = np.array([[member(w, c, a, b) for w, c in members] for a, b in ((0.5, 1.0), (-1.0, 0.25))])
        means[depth], deviations = p.mean(axis=1), p.std(axis=1, ddof=1)
        assert out[0, 0][f"mean_{depth}"] == pytest.approx(means[depth][0])
        assert out[0, 5][f"std_{depth}"] == pytest.approx(deviations[1])
        assert out[1, 3][f"mean_{depth}"] == pytest.approx(means[depth].mean())
    assert out[0, 0]["fused"] == pytest.approx((means["near"][0] + means["far"][0]) / 2)
    assert len(out) == 24 and out[1, 3]["n_tiles"] == 2


def test_small_samples_grow_without_spark_ml(spark, cells, monkeypatch):
    """Spark ML took minutes for a forest of 500 deep trees; a sample that fits a task is sent to all of them."""
    train = labels.with_weights(labels.stratified_sample(cells, 3))
    with monkeypatch.context() as m:
        m.setattr(models, "RandomForestClassifier", None)
        forest, again = (models.fit_forest(t, ["a", "b"], trees=40, depth=30) for t in (train, train.orderBy(F.desc("b"))))
    got, same = ({(r["row"], r["col"]): r["score"] for r in models.score(f, cells).collect()} for f in (forest, again))
    assert got == same and len(got) == 3000
    monkeypatch.setattr(models, "SENT_ROWS", 10)
    library = models.fit_forest(train, ["a", "b"], trees=40, depth=30)
    assert library.grown is None
    auc = [metrics.auc_roc(models.score(f, cells)).first()["auc_roc"] for f in (forest, library)]
    assert abs(auc[0] - auc[1]) < 0.02
    shares = [{r["feature"]: r["importance"] for r in models.forest_importance(f, ["a", "b"], spark).collect()} for f in (forest, library)]
    assert abs(shares[0]["a"] - shares[1]["a"]) < 0.1


def test_trees_hold_their_bounds():
    from cellweave.operators.trees import Sample, grow, probability, thresholds

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 4, 2000), np.zeros(2000)])
    y = (x[:, 0] + x[:, 1] + rng.normal(size=2000) > 2).astype(float)
    w = np.where(y == 1, 1.0, 0.1)
    for depth in (0, 3, 30):
        feature, value, child, gain = grow(Sample(x, y, w), [1, 2], depth, 5)
        drawn = np.random.default_rng([1, 2]).poisson(1.0, 2000)
        node, steps = np.zeros(2000, int), 0
        while (feature[node] >= 0).any():
            inner = feature[node] >= 0
            node[inner] = child[node[inner]] + (x[inner, feature[node[inner]]] > value[node[inner]])
            steps += 1
        leaf = feature < 0
        assert steps <= depth and np.bincount(node, drawn, len(feature))[leaf].min() >= 5 and gain[2] == 0 and len(np.unique(value[feature == 0])) <= 31
        share = np.bincount(node, drawn * w * y, len(feature))[leaf] / np.bincount(node, drawn * w, len(feature))[leaf]
        assert np.allclose(share, value[leaf]) and np.allclose(probability([(feature, value, child)], x), value[node])
    # A tree that looks at all features splits at the best of its thresholds.
    feature, value, _, _ = grow(Sample(x[:, :1].copy(), y, w), [5], 1, 5)
    cuts = thresholds(x[:, 0], w)
    assert len(cuts) == 31 and value[0] in cuts and np.ptp([w[(x[:, 0] > a) & (x[:, 0] <= b)].sum() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]) <= 2
    drawn = np.random.default_rng([5]).poisson(1.0, 2000)

    def impurity(cut):
        parts = [(drawn * w * m, drawn * w * y * m) for m in (x[:, 0] <= cut, x[:, 0] > cut)]
        return sum(p.sum() * (t.sum() - p.sum()) / t.sum() for t, p in parts if (drawn * (t > 0)).sum() >= 5)

    assert impurity(value[0]) <= min(impurity(c) for c in cuts) + 1e-9


def test_a_forest_of_one_class_and_rows_with_unknown_features(spark):
    rows = [(i, float(i % 7) if i % 5 else None, 0, 1.0) for i in range(60)]
    train = spark.createDataFrame(rows, "id long, a double, label long, weight double")
    only = models.score(models.fit_forest(train, ["a"], trees=4, depth=3), train)
    assert only.count() == 48 and only.where("score <> 1").isEmpty()
    ones = models.fit_forest(train.withColumn("label", F.lit(1)), ["a"], trees=4, depth=3)
    assert {r["score"] for r in models.score(ones, train).collect()} == {1.0}


def test_a_logistic_fit_does_not_read_its_rows_in_every_step(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3) if i % 7 else None, float(rng.normal()), float(rng.normal()), int(rng.random() < 0.3), 0.5) for i in range(600)]
    table = spark.createDataFrame(rows, "fold bigint, a double, b double, label bigint, weight double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    fitted = fit_logistic_groups(table.mapInArrow(counted, table.schema), ["a", "b"], ["fold"], {"full": ["a", "b"], "no_b": ["a"]})
    assert read.value <= 2 * len(rows)  # to list the groups and to write the blocks
    assert {k for k in fitted} == {(f, v) for f in (0, 1, 2, None) for v in ("full", "no_b")}
    assert np.allclose(fitted[(None, "full")], fit_logistic_groups(table.where("fold IS NULL"), ["a", "b"])[("full",)], atol=1e-8)
    assert fitted[(1, "no_b")][2] == 0.0


def test_forests_are_fitted_on_every_positive_cell(spark, tmp_path, monkeypatch):
    """At most 5,000 positive cells of a fold took part in the fits that m1, m2, m7 and m10 share."""
    from cellweave.catalog import models as catalog

    n = 12_000
    orders = spark.range(n).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "string(id % 5) AS o_orderpriority", "double(hash(id) % 1000) AS o_totalprice")
    lines = spark.range(n).selectExpr(
        "id AS l_orderkey", "double(45 + id % 5) AS l_quantity", "(id % 11) / 100D AS l_discount", "(id % 9) / 100D AS l_tax",
        "if(pmod(hash(id, 1), 10) < 8, 'R', 'N') AS l_returnflag",
    )
    customers = spark.range(7).selectExpr("id AS c_custkey", "double(id) AS c_acctbal")
    for name, table in {"orders": orders, "lineitem": lines, "customer": customers}.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(catalog, "FOREST", {"trees": 4, "depth": 4})
    folds, forests = catalog._forests(spark, str(tmp_path))
    positive = [i for i, r in enumerate(lines.orderBy("l_orderkey").collect()) if r["l_returnflag"] == "R"]
    for strip in labels.fold_strips(100, 5, 5):
        far = [i for i in positive if not strip["train_left"] <= i % 100 < strip["train_right"]]
        fitted = folds[strip["fold"]].train.where("label = 1")
        assert len(far) > 6000 and {r["row"] * 100 + r["col"] for r in fitted.collect()} == set(far)
        assert forests[strip["fold"]].grown is not None
    assert catalog.m10(spark, str(tmp_path)).where("score >= 0").count() == n


def test_trees_of_merged_rows_and_of_any_weights(monkeypatch):
    """Equal rows count once with their number; weights that differ within a class are added up; levels go on in batches."""
    from cellweave.operators import trees

    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 6, 3000), rng.normal(size=3000)])
    y = (x[:, 0] + x[:, 1] + rng.normal(size=3000) > 3).astype(float)
    for w in (np.where(y == 1, 1.0, 0.1), rng.choice([0.5, 1.0, 2.0], 3000)):
        rows = trees.Sample(x, y, w).binned()
        merged = rows.merged()
        assert len(merged.y) < 3000 and merged.count.sum() == 3000
        assert np.isclose((merged.count * merged.weight * merged.y).sum(), (w * y).sum())
        back = np.repeat(np.arange(len(merged.y)), merged.count.astype(int))
        whole = np.column_stack([*rows.columns, y, w])
        again = np.column_stack([*merged.columns[:, back], merged.y[back], merged.weight[back]])
        assert (whole[np.lexsort(whole.T)] == again[np.lexsort(again.T)]).all()
        for batch in (1 << 17, 100):
            monkeypatch.setattr(trees, "BATCH_ROWS", batch)
            feature, value, child, gain = trees.grow(merged, [7], 30, 5)
            drawn = np.random.default_rng([7]).poisson(merged.count)
            node = np.zeros(len(merged.y), int)
            points = np.array([np.append(-np.inf, cut)[column] for cut, column in zip(merged.cuts, merged.columns, strict=True)]).T
            while (feature[node] >= 0).any():
                inner = feature[node] >= 0
                # A row lies above a threshold when it is above the last one below it.
                node[inner] = child[node[inner]] + (points[inner, feature[node[inner]]] >= value[node[inner]])
            leaf = feature < 0
            assert leaf.sum() > 20 and gain.min() > 0 and np.bincount(node, drawn, len(feature))[leaf].min() >= 5
            share = np.bincount(node, drawn * merged.weight * merged.y, len(feature)) / np.bincount(node, drawn * merged.weight, len(feature)).clip(1e-9)
            assert np.allclose(share[leaf], value[leaf])


def test_large_tables_are_told_and_scored_by_all_rows(spark, monkeypatch):
    """Spark ML took the thresholds of more than 10,000 rows from a draw, and a forest was gathered on the driver to score."""
    from cellweave.operators import trees

    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=12_000), rng.integers(0, 9, 12_000), rng.integers(0, 60, 12_000) / 7, np.full(12_000, 2.0)])
    x[0, 0] = 1e6
    y = (x[:, 0] + x[:, 1] / 3 + rng.normal(size=12_000) > 2).astype(int)
    rows = [(*map(float, v), int(c), 1.0 if c else 0.1) for v, c in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 2.0, 1, 1.0), (float("nan"), 1.0, 1.0, 2.0, 0, 0.1)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, label long, weight double").withColumn("id", F.monotonically_increasing_id()).cache()
    features = ["a", "b", "c", "d"]
    loose = table.withColumn("weight", F.col("a") * F.col("a") % 1 + 0.01)  # no weights that end on a share
    for weighted in (table, loose):
        known = trees.known_rows(weighted, features, "weight")
        local = trees.Sample.of(weighted, features, "weight", 10**6)
        got = trees.table_thresholds(known, 4)
        assert [len(c) for c in got] == [31, 8, 31, 0]
        if weighted is loose:
            assert all(np.allclose(g, trees.thresholds(column, local.weight)) for g, column in zip(got, local.x.T, strict=True))

    monkeypatch.setattr(models, "ORDERED_ROWS", 10)
    forest = models.fit_forest(loose, features, trees=20, depth=30)
    monkeypatch.setattr(models, "READ_ROWS", 10)
    told = models.fit_forest(loose, features, trees=20, depth=30)
    monkeypatch.setattr(trees, "TREE_NODES", 10)
    monkeypatch.setattr(trees, "KEYS_SENT", 1000)
    monkeypatch.setattr(trees, "KEY_BLOCK", 300)
    want = {r["id"]: r["score"] for r in models.score(forest, table).collect()}
    assert len(want) == 12_000 and told.grown.nodes > 1000 and "_trees" not in vars(forest.grown)
    monkeypatch.setattr(trees, "TREE_NODES", 10**9)
    for scored in (models.score(forest, table), models.score(told, table)):
        got = {r["id"]: r["score"] for r in scored.collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-9
    assert [p.featureImportances for p in told.parts] == [p.featureImportances for p in forest.parts]

    monkeypatch.setattr(models, "SENT_ROWS", 10)
    library = models.fit_forest(table, features, trees=10, depth=5)
    assert library.grown is None and len(library.cuts[0]) == 31
    assert metrics.auc_roc(models.score(library, table)).first()["auc_roc"] > 0.75
