"""Baselines under spatial cross-validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import all_present
from cellweave.operators.evidence import woe_fit, woe_posterior
from cellweave.operators.labels import spatial_folds, stratified_sample, with_weights
from cellweave.operators.logistic import fit_logistic_groups, score_logistic
from cellweave.operators.metrics import evaluate, fold_summary
from cellweave.operators.models import fit_forests, score
from cellweave.operators.normalize import fill_with, standardize, standardize_fit, unpivot_bands
from cellweave.operators.runs import ablation_drop
from cellweave.scale import exact_percentiles
from cellweave.session import stored


def woe_baseline(
    cells: DataFrame, bands: Sequence[str], strips: Sequence[Mapping[str, int]], ratio: float = 10, seed: int = 42,
    first_band: str | None = None, score_decimals: int | None = None, decimals: int | None = None,
) -> DataFrame:
    """Metrics per fold of the posterior on sampled test cells.

    Weights come from the whole table; all folds are sampled and evaluated as groups of one
    job, with the seed moving with the fold.
    """
    scored = woe_posterior(cells, woe_fit(cells, bands, decimals=decimals), first_band or bands[0])
    value = F.col("posterior") if score_decimals is None else F.round("posterior", score_decimals)
    posterior = scored.select("row", "col", "label", value.alias("score"))
    test = spatial_folds(posterior, strips).where(F.col("region") == "test")
    sampled = stratified_sample(stored(test, "posterior"), ratio, F.lit(seed) + F.col("fold"), by=["fold"])
    return evaluate(sampled, by=["fold"])


def _part() -> Column:
    """One number for fold and region, odd for `test`: rows meet their group by it at less cost than by two columns."""
    return F.col("fold") * 2 + (F.col("region") == "test").cast("bigint")


def fold_samples(
    cells: DataFrame, bands: Sequence[str], strips: Sequence[Mapping[str, int]],
    train_ratio: float = 5, val_ratio: float = 5, cap: int | None = None, seed: int = 42,
) -> DataFrame:
    """Training and validation samples of all listed folds as one stored table (`fold`, `region`).

    All folds are drawn as groups of one job; the samples are small next to the grid and are
    read by every pass of every fit.
    """
    used = spatial_folds(cells.where(all_present(bands)).select("row", "col", "label", *bands), strips).withColumn("_part", _part())
    train = F.col("_part") % 2 == 0
    sampled = stratified_sample(
        used,
        F.when(train, F.lit(float(train_ratio))).otherwise(F.lit(float(val_ratio))),
        F.lit(seed) + F.col("fold") + F.when(train, 0).otherwise(1000),
        None if cap is None else F.when(train, F.lit(cap)),
        by=["_part"],
    ).drop("_part")
    return stored(sampled, "samples")


@dataclass(frozen=True)
class Prepared:
    """A fold's training and validation rows, and what was learned to prepare others like them."""

    train: DataFrame
    validation: DataFrame
    medians: Mapping[str, float]
    scaler: Mapping[str, tuple[float, float]]

    def apply(self, cells: DataFrame) -> DataFrame:
        """Fill unknown values with the training medians and scale as the training rows."""
        return standardize(fill_with(cells, self.medians), self.scaler)


def fold_tables(samples: DataFrame, bands: Sequence[str], folds: Sequence[int]) -> dict[int, Prepared]:
    """Per fold the imputed and standardised training and validation rows.

    The medians of all folds, regions and bands come from one pass.  Training medians fill
    the training rows; validation rows take their own medians first.
    """
    # One number for fold, region and band: every value meets its group by it, which is far cheaper than by their names.
    long = unpivot_bands(samples.withColumn("_part", _part()), bands, keys=("_part",))
    place = F.coalesce(*[F.when(F.col("band") == b, i) for i, b in enumerate(bands)])
    grouped = long.select((F.col("_part") * len(bands) + place).alias("_group"), "value")
    medians: dict[tuple[int, str], dict[str, float]] = {}
    for r in exact_percentiles(grouped, "value", [0.5], ["_group"]).collect():
        (fold, test), band = divmod(r["_group"] // len(bands), 2), bands[r["_group"] % len(bands)]
        medians.setdefault((fold, "test" if test else "train"), {})[band] = r["pct"][0]
    tables = {}
    for fold in folds:
        learned, own = medians.get((fold, "train"), {}), medians.get((fold, "test"), {})
        mine = samples.where(F.col("fold") == fold)
        train = fill_with(mine.where(F.col("region") == "train"), learned)
        validation = fill_with(fill_with(mine.where(F.col("region") == "test"), own), learned)
        fitted = standardize_fit(train, bands)
        tables[fold] = Prepared(with_weights(standardize(train, fitted)), standardize(validation, fitted), learned, fitted)
    return tables


def together(folds: Mapping[int, Prepared]) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of all folds (`fold`); those of validation, which are scored, as one stored table."""
    train = reduce(DataFrame.unionByName, [f.train for f in folds.values()])
    validation = reduce(DataFrame.unionByName, [f.validation for f in folds.values()])
    return train, stored(validation, "validation")


def spatial_cv(
    cells: DataFrame, bands: Sequence[str], strips: Sequence[Mapping[str, int]], kind: str = "forest",
    samples: DataFrame | None = None, **options,
) -> DataFrame:
    """Metrics per fold of a forest or logistic model; the folds are fitted side by side and evaluated together."""
    drawn = fold_samples(cells, bands, strips) if samples is None else samples
    folds = fold_tables(drawn, bands, [s["fold"] for s in strips])
    if kind == "forest":
        forests = fit_forests([f.train for f in folds.values()], bands, **options)
        scored = [score(m, f.validation).select("fold", "label", "score") for m, f in zip(forests, folds.values(), strict=True)]
        return evaluate(stored(reduce(DataFrame.unionByName, scored), "scored"), by=["fold"])  # read by every metric
    train, validation = together(folds)
    fitted = fit_logistic_groups(train, bands, ["fold"], **options)
    return evaluate(score_logistic(validation, bands, ["fold"], fitted).select("fold", "label", "score"), by=["fold"])


def cv_summary(metrics: DataFrame) -> DataFrame:
    return fold_summary(metrics, ["auc_pr", "auc_roc", "f1"])


def channel_ablation(cells: DataFrame, variants: Mapping[str, Sequence[str]], strips: Sequence[Mapping[str, int]], **options) -> DataFrame:
    """`fold, variant, auc_pr, drop`: logistic models with each set of bands, compared with `full`.

    All variants see the same rows; the models of all folds and variants are fitted and evaluated together.
    """
    every = list(dict.fromkeys(b for bands in variants.values() for b in bands))
    folds = fold_tables(fold_samples(cells, every, strips), every, [s["fold"] for s in strips])
    train, validation = together(folds)
    fitted = fit_logistic_groups(train, every, ["fold"], variants, **options)
    scored = score_logistic(validation, every, ["fold"], fitted).select("fold", "variant", "label", "score")
    return ablation_drop(evaluate(scored, by=["fold", "variant"]).select("fold", "variant", "auc_pr"), "auc_pr")
