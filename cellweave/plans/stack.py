"""From layers to the band stack: feature suite, potential-field suite, stacking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.grid import Grid, grid_cells
from cellweave.operators.neighbourhood import (
    contact_density,
    fault_density,
    intersection_density,
    local_variance_sum,
    nearest_feature_distance,
    regrid,
)
from cellweave.operators.normalize import join_bands, mean_impute, normalize_channels, robust_normalize
from cellweave.operators.spectral import (
    analytic_signal,
    derivatives,
    first_vertical_derivative,
    spectrum,
    svd_lowrank,
    tilt_derivative,
    trend_residual,
    where_known,
)
from cellweave.session import stored
from cellweave.sources.inventory import best_match_layer


def feature_suite(cells: DataFrame, distances: Sequence[str], codes: Sequence[str], grid: Grid) -> DataFrame:
    """All derived layers of one map scale as columns of one cell table.

    Every distance layer gives a kernel density; two or more give an intersection density;
    every code layer gives a contact density; distances together give the complexity; a
    fault and a shear layer (by name) give the distance to their intersections.
    """
    parts = []
    if distances:
        density = fault_density(cells, distances, grid)
        parts.append(density.select("row", "col", *[F.col(d).alias(f"{d}_kde_density") for d in distances]))
        complexity = local_variance_sum(cells, distances, grid)
        parts.append(complexity.withColumnRenamed("complexity", "structural_complexity"))
    if len(distances) >= 2:
        parts.append(intersection_density(cells, distances, grid).withColumnRenamed("density", "intersection_density"))
    for code in codes:
        parts.append(contact_density(cells, code, grid).withColumnRenamed("contact", f"{code}_contact_density"))
    fault = next((d for d in reversed(list(distances)) if "fault" in d.lower()), None)
    shear = next((d for d in reversed(list(distances)) if "shear" in d.lower()), None)
    if fault and shear:
        parts.append(nearest_feature_distance(cells, fault, shear, grid, name="intersection_distance"))
    return join_bands(parts)


def potential_field_suite(
    cells: DataFrame, value: str, grid: Grid, rank: int | None = None, heights: Sequence[float] = (500, 1000, 2000)
) -> DataFrame:
    """Filtered field, trend, residual, derivatives and continuations, plus six scaled bands.

    The filtered field and the one spectrum that every derivative shares are the two reuse
    points; both are stored in the shared folder so later branches do not redo them.
    """
    filtered = stored(svd_lowrank(cells, value, grid, rank).withColumnRenamed("filtered", "tmi"), "field")
    trend = trend_residual(filtered, "tmi", grid)
    spec = stored(spectrum(filtered, "tmi", grid), "spectrum")
    ups = [f"up_{int(h)}" for h in heights]
    products = derivatives(spec, grid, heights).select(
        "row", "col",
        first_vertical_derivative().alias("vd1"), analytic_signal().alias("asa"), tilt_derivative().alias("tdr"), *ups,
    )
    joined = filtered.join(trend, ["row", "col"]).join(where_known(products, filtered, "tmi"), ["row", "col"])
    wide = stored(joined, "products")
    bands = ["tmi", "regional", "residual", "vd1", "asa", "tdr"]
    scaled = wide.select("*", *[F.col(b).alias(f"{b}_norm") for b in bands])
    return robust_normalize(scaled, [f"{b}_norm" for b in bands])


def stack_bands(
    spark, layers: Sequence[tuple[str, DataFrame | None, Grid | None, bool]], grid: Grid
) -> DataFrame:
    """The band stack: `row, col` and one complete column per layer.

    `layers` lists (name, `row,col,value` table, its frame, scale it?).  A missing layer is
    0; others are resampled, scaled where asked for, and mean-filled.
    """
    target = grid_cells(spark, grid)
    wide = target
    present = []
    for name, layer, frame, _ in layers:
        if layer is not None:
            sampled = regrid(layer, frame or grid, grid, target).withColumnRenamed("value", name)
            wide = wide.join(sampled, ["row", "col"], "left")
            present.append(name)
    wide = stored(wide, "stack")  # scanned for the percentiles, the means and the result
    scale = [n for n, layer, _, wanted in layers if layer is not None and wanted]
    filled = mean_impute(normalize_channels(wide, scale), present)
    return filled.select("row", "col", *[F.col(n) if n in present else F.lit(0.0).alias(n) for n, *_ in layers])


def channel_stack(
    spark,
    files: DataFrame,
    channels: Sequence[tuple[str, Sequence[str], Sequence[str], bool]],
    open_layer: Callable[[str], tuple[DataFrame, Grid]],
    grid: Grid,
) -> DataFrame:
    """The band stack from an inventory (`path, stem`): every channel takes the file that matches it best.

    `channels` lists (name, keywords in priority order, excluded words, scale it?) in band order; `open_layer`
    turns a path into a `row, col, value` table and its frame.  Channels without a file are 0.
    """
    matched = best_match_layer(files, [(name, words, without) for name, words, without, _ in channels])
    paths = {r["channel"]: r["path"] for r in matched.collect()}  # a row for each channel at most
    layers = []
    for name, _, _, scale in channels:
        table, frame = open_layer(paths[name]) if name in paths else (None, None)
        layers.append((name, table, frame, scale))
    return stack_bands(spark, layers, grid)
