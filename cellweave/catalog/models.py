"""Queries: classifiers, tile scoring, uncertainty, cross-validation, ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.catalog import fixtures as fx
from cellweave.catalog.registry import query
from cellweave.functions.scalars import all_present
from cellweave.operators import labels, models, tiles
from cellweave.operators.logistic import fit_logistic_groups, score_logistic
from cellweave.operators.metrics import evaluate
from cellweave.plans import baselines
from cellweave.session import stored

BANDS = fx.BANDS
P, S = fx.PATCH, fx.STRIDE
#: Spark ML grows trees to depth 30 at most, the original's have no limit.
FOREST = {"trees": 500, "depth": 30}
PASSES = 50


_FORESTS: dict[tuple[str, str], tuple[dict, list]] = {}


def _forests(spark, folder):
    """The folds and their forests; several queries of a session read the same fits.

    Every positive cell of a fold's training region takes part in its fit, with the fold's unlabeled cells in the usual ratio.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FORESTS:
        cells = fx.stored_cells(spark, folder).select("row", "col", "label", *BANDS)
        strips = fx.strips(fx.cell_grid(spark, folder))
        samples = baselines.fold_samples(cells, BANDS, strips)
        folds = baselines.fold_tables(samples, BANDS, [s["fold"] for s in strips])
        _FORESTS[key] = (folds, models.fit_forests([f.train for f in folds.values()], BANDS, **FOREST))
    return _FORESTS[key]


@query("m1_rf_baseline")
def m1(spark, folder):
    """Scores of the validation rows of all folds."""
    folds, forests = _forests(spark, folder)
    scored = [models.score(m, f.validation).select("fold", "row", "col", "label", "score") for m, f in zip(forests, folds.values(), strict=True)]
    return reduce(DataFrame.unionByName, scored)


@query("m2_rf_importance")
def m2(spark, folder):
    """Importances of all folds."""
    folds, forests = _forests(spark, folder)
    tables = [models.forest_importance(m, BANDS, spark).withColumn("fold", F.lit(k).cast("bigint")) for k, m in zip(folds, forests, strict=True)]
    return reduce(DataFrame.unionByName, tables)


def _tile_features(spark, folder):
    """Tile centres with scaled channel means and the label of the centre cell."""
    grid = fx.cell_grid(spark, folder)
    means = tiles.patch_channel_mean(fx.stored_cells(spark, folder), BANDS, grid.height, grid.width, P, S)
    centred = means.withColumn("row", F.col("r") + P // 2).withColumn("col", F.col("c") + P // 2).drop("r", "c")
    scaled = centred.select(
        "row", "col", (F.col("b1") / 5e5).alias("b1"), (F.col("b2") / 350).alias("b2"), (F.col("b3") * 10).alias("b3"),
        (F.col("b4") * 10).alias("b4"), (F.col("b5") / 1e4).alias("b5"),
    )
    labelled = scaled.join(fx.stored_cells(spark, folder).select("row", "col", "label"), ["row", "col"])
    return stored(labelled, "tiles")  # read by every pass of a fit


@query("m3_batch_score_tiles")
def m3(spark, folder):
    grid = fx.cell_grid(spark, folder)
    features = _tile_features(spark, folder)
    terms = models.fit_logistic(labels.with_weights(features), BANDS)
    valid = tiles.inference_tiles(fx.stored_cells(spark, folder), BANDS, grid.height, grid.width, P)
    scored = models.score_linear(terms, BANDS, features.join(valid.select("row", "col"), ["row", "col"]))
    return models.score_tiles(scored, grid.height, grid.width, P, S)


@query("m4_ensemble_uncertainty")
def m4(spark, folder):
    features = _tile_features(spark, folder)
    ensemble = models.fit_ensemble(features, BANDS, passes=PASSES, ratio=2.0)
    return models.ensemble_uncertainty(features, BANDS, ensemble, ["row", "col"])


@query("m6_pu_logistic")
def m6(spark, folder):
    features = _tile_features(spark, folder)
    terms = models.fit_logistic(labels.with_weights(features), BANDS)
    return models.score_linear(terms, BANDS, features).select("row", "col", "label", "score")


@query("m7_spatial_cv")
def m7(spark, folder):
    """Metrics of every fold for both kinds of model."""
    folds, forests = _forests(spark, folder)
    train, validation = baselines.together(folds)
    fitted = fit_logistic_groups(train, BANDS, ["fold"])
    logistic = score_logistic(validation, BANDS, ["fold"], fitted).select("fold", "label", "score", F.lit("logistic").alias("kind"))
    scored = [models.score(m, f.validation).select("fold", "label", "score", F.lit("forest").alias("kind")) for m, f in zip(forests, folds.values(), strict=True)]
    return evaluate(stored(reduce(DataFrame.unionByName, scored, logistic), "scored"), by=["kind", "fold"])


@query("m7_cv_summary")
def m7_summary(spark, folder):
    grid = fx.cell_grid(spark, folder)
    cells = fx.stored_cells(spark, folder).select("row", "col", "label", *BANDS)
    return baselines.cv_summary(baselines.spatial_cv(cells, BANDS, fx.strips(grid), "logistic"))


@query("m8_channel_ablation")
def m8(spark, folder):
    """All folds; each variant leaves one band out."""
    grid = fx.cell_grid(spark, folder)
    cells = fx.stored_cells(spark, folder).select("row", "col", "label", *BANDS)
    variants = {"full": BANDS, **{f"no_{b}": [x for x in BANDS if x != b] for b in BANDS}}
    return baselines.channel_ablation(cells, variants, fx.strips(grid))


@query("m10_pixel_map_rf")
def m10(spark, folder):
    """Every valid cell, filled and scaled as the training rows of the first fold."""
    folds, forests = _forests(spark, folder)
    cells = fx.stored_cells(spark, folder).select("row", "col", "label", *BANDS)
    first = list(folds).index(min(folds))
    ready = folds[min(folds)].apply(cells.withColumn("_known", all_present(BANDS)))
    return models.pixel_map(ready, forests[first], F.col("_known"))
