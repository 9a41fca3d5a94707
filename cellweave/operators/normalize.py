"""Scaling and imputation of bands in a wide cell table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import clip
from cellweave.scale import exact_percentiles


def unpivot_bands(cells: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Long form `keys..., band, value`; the bands are cast to DOUBLE."""
    typed = cells.select(*keys, *[F.col(b).cast("double").alias(b) for b in bands])
    return typed.unpivot(list(keys), list(bands), "band", "value")


def band_percentiles(cells: DataFrame, bands: Sequence[str], probs: Sequence[float], **options) -> dict[str, list[float]]:
    """Exact percentiles of every band that has a value; one pass over the table for all bands."""
    long = unpivot_bands(cells, bands, keys=())
    # One row per band of the schema.
    return {r["band"]: list(r["pct"]) for r in exact_percentiles(long, "value", probs, ["band"], **options).collect()}


def _replace(cells: DataFrame, new: dict[str, Column]) -> DataFrame:
    return cells.select(*[new[c].alias(c) if c in new else F.col(c) for c in cells.columns])


def robust_normalize(cells: DataFrame, bands: Sequence[str], **options) -> DataFrame:
    """2nd to 98th percentile stretch to 0..1 with a small epsilon in the range."""
    found = band_percentiles(cells, bands, [0.02, 0.98], **options)
    return _replace(
        cells,
        {
            b: clip((F.col(b).cast("double") - found[b][0]) / (found[b][1] - found[b][0] + 1e-8), 0.0, 1.0)
            if b in found
            else F.col(b).cast("double")
            for b in bands
        },
    )


def normalize_channels(cells: DataFrame, bands: Sequence[str], **options) -> DataFrame:
    """As `robust_normalize` without epsilon: flat bands become 0, empty ones stay as they are."""
    found = band_percentiles(cells, bands, [0.02, 0.98], **options)

    def stretched(band: str) -> Column:
        v = F.col(band).cast("double")
        if band not in found:
            return v
        low, high = found[band]
        if high - low < 1e-8:
            return F.lit(0.0)
        return clip((v - low) / (high - low), 0.0, 1.0)

    return _replace(cells, {b: stretched(b) for b in bands})


def rgb_composite(cells: DataFrame, bands: Sequence[str], **options) -> DataFrame:
    """Percentile stretch per colour with NULL shown as 0."""
    found = band_percentiles(cells, bands, [0.02, 0.98], **options)
    return _replace(
        cells,
        {
            b: F.coalesce(
                clip((F.col(b).cast("double") - found[b][0]) / (found[b][1] - found[b][0] + 1e-9), 0.0, 1.0), F.lit(0.0)
            )
            if b in found
            else F.lit(0.0)
            for b in bands
        },
    )


def mean_impute(cells: DataFrame, bands: Sequence[str]) -> DataFrame:
    """NULL becomes the band mean; 0 in a band without values."""
    means = cells.agg(*[F.avg(F.col(b).cast("double")).alias(b) for b in bands]).first()
    return _replace(cells, {b: F.coalesce(F.col(b).cast("double"), F.lit(float(means[b] or 0.0))) for b in bands})


def band_medians(cells: DataFrame, bands: Sequence[str], **options) -> dict[str, float]:
    return {b: p[0] for b, p in band_percentiles(cells, bands, [0.5], **options).items()}


def fill_with(cells: DataFrame, values: dict[str, float]) -> DataFrame:
    return _replace(cells, {b: F.coalesce(F.col(b).cast("double"), F.lit(float(v))) for b, v in values.items()})


def median_impute(
    train: DataFrame, validation: DataFrame, predict: DataFrame, bands: Sequence[str], **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training medians fill training and prediction rows.

    Validation rows are filled with their own medians first and only what is still missing
    (a band without a single validation value) with the training medians.
    """
    learned = band_medians(train, bands, **options)
    own = band_medians(validation, bands, **options)
    return fill_with(train, learned), fill_with(fill_with(validation, own), learned), fill_with(predict, learned)


def standardize_fit(train: DataFrame, bands: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per band; a constant band gets scale 1."""
    aggregates = [f(F.col(b).cast("double")).alias(f"{n}_{b}") for b in bands for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = train.agg(*aggregates).first()
    return {b: (float(row[f"m_{b}"] or 0.0), float(row[f"s_{b}"] or 0.0) or 1.0) for b in bands}


def standardize(cells: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return _replace(cells, {b: (F.col(b).cast("double") - m) / s for b, (m, s) in fitted.items()})


def join_bands(frames: Sequence[DataFrame]) -> DataFrame:
    """Equi-join single-band grids on their address."""
    return reduce(lambda a, b: a.join(b, ["row", "col"], "full"), frames)
