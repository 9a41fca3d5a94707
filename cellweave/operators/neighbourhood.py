"""Neighbourhood operators on a complete grid: distances, densities, contacts, variance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalars import within
from cellweave.grid import Grid
from cellweave.operators.lines import filter_lines, map_lines, squared_distance_lines
from cellweave.session import stored


def max_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide each column by its maximum where that is positive."""
    tops = df.agg(*[F.max(c).alias(c) for c in columns])
    out = df
    for c in columns:
        top = tops.select(c).scalar()
        out = out.withColumn(c, F.when(top > 0, F.col(c) / top).otherwise(F.col(c)))
    return out


def distance_transform(
    cells: DataFrame, mask: Column, grid: Grid, name: str = "distance", keep: Sequence[str] = ()
) -> DataFrame:
    """`row, col, keep..., <name>`: exact Euclidean distance in metres to the nearest cell in `mask`.

    Down the columns the nearest masked row above and below comes from two ordered windows.
    Along the rows the parabolas of those gaps are minimised strip by strip.  Every cell is
    shuffled twice and no pair of cells is ever formed.  NULL everywhere if nothing is masked.
    """
    marked = cells.select("row", "col", *keep, F.when(mask, F.col("row")).alias("_m"))
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    gaps = marked.select(
        "row",
        "col",
        *keep,
        F.last("_m", ignorenulls=True).over(up).alias("_above"),
        F.last("_m", ignorenulls=True).over(down).alias("_below"),
    )
    gap = F.least(F.col("row") - F.col("_above"), F.col("_below") - F.col("row")).cast("double")
    squared = map_lines(
        gaps.select("row", "col", *keep, gap.alias("_gap")), "row", grid.width, lambda g: [squared_distance_lines(g)], ["_gap"], ["_d2"], keep
    )
    return squared.select("row", "col", *keep, (F.sqrt("_d2") * grid.xres).alias(name))


def nearest_feature_distance(
    cells: DataFrame, first: str, second: str, grid: Grid, threshold: float = 150.0, name: str = "distance"
) -> DataFrame:
    """Distance to the nearest cell that is close to both layers.

    NULL where either input is NULL; 0 everywhere when no such cell exists.
    """
    both = within(F.col(first), threshold) & within(F.col(second), threshold)
    known = F.col(first).isNotNull() & F.col(second).isNotNull()
    flagged = cells.select("row", "col", both.alias("_m"), known.alias("_known"))
    distance = distance_transform(flagged, F.col("_m"), grid, "_d", ["_known"])
    # A distance is missing only when no cell at all is close to both.
    value = F.when(F.col("_d").isNull(), F.lit(0.0)).when(F.col("_known"), F.col("_d"))
    return distance.select("row", "col", value.alias(name))


def gaussian_weights(sigma: float) -> np.ndarray:
    """Normalised Gaussian taps out to four sigma."""
    radius = int(4 * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    return weights / weights.sum()


def box_weights(size: int) -> np.ndarray:
    return np.full(size, 1.0 / size)


def separable_filter(cells: DataFrame, columns: Sequence[str], weights: np.ndarray, grid: Grid) -> DataFrame:
    """Filter down the columns, then along the rows; boundary reflected, NULL counts as 0."""

    def kernel(*planes):
        return [filter_lines(p, weights) for p in planes]

    vertical = map_lines(cells, "col", grid.height, kernel, columns, columns)
    return map_lines(vertical, "row", grid.width, kernel, columns, columns)


def gaussian_density(cells: DataFrame, columns: Sequence[str], sigma: float, grid: Grid) -> DataFrame:
    """Gaussian kernel density of each column, scaled to a maximum of 1.

    The filtered grid is stored before its maximum is taken, so nothing is filtered twice.
    """
    filtered = stored(separable_filter(cells, columns, gaussian_weights(sigma), grid), "filtered")
    return max_normalize(filtered, columns)


def binary_near(distance: Column, threshold: float) -> Column:
    return within(distance, threshold).cast("double")


def fault_density(cells: DataFrame, distances: Sequence[str], grid: Grid, bandwidth: float = 2000.0, res: float = 50.0) -> DataFrame:
    """Density of the cells within one cell size of each layer."""
    near = cells.select("row", "col", *[binary_near(F.col(d), res).alias(d) for d in distances])
    return gaussian_density(near, list(distances), bandwidth / res, grid)


def intersection_count(distances: Sequence[str], threshold: float = 200.0) -> Column:
    """How many layers come within the threshold; 0 when there are fewer than two layers."""
    if len(distances) < 2:
        return F.lit(0.0)
    total = F.lit(0.0)
    for d in distances:
        total = total + within(F.col(d), threshold).cast("double")
    return total


def intersection_density(cells: DataFrame, distances: Sequence[str], grid: Grid, threshold: float = 200.0) -> DataFrame:
    counted = cells.select("row", "col", intersection_count(distances, threshold).alias("density"))
    return gaussian_density(counted, ["density"], 5.0, grid)


def neighbour_differs(cells: DataFrame, value: str) -> DataFrame:
    """`row, col, down, right`: 1 where the value differs from the cell below / to the right.

    NULL counts as code 0; the last row and the last column contribute 0.
    """
    coded = cells.select("row", "col", F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias("_v"))
    below = Window.partitionBy("col").orderBy("row")
    beside = Window.partitionBy("row").orderBy("col")

    def differs(window, axis: str) -> Column:
        adjacent = F.lead(axis).over(window) == F.col(axis) + 1
        return F.when(adjacent & (F.lead("_v").over(window) != F.col("_v")), 1).otherwise(0)

    return coded.withColumn("down", differs(below, "row")).withColumn("right", differs(beside, "col")).drop("_v")


def contact_mask(cells: DataFrame, value: str) -> DataFrame:
    """`row, col, contact`: 1 on cells that border a different code below or to the right."""
    differs = neighbour_differs(cells, value)
    return differs.select("row", "col", F.least(F.col("down") + F.col("right"), F.lit(1)).cast("double").alias("contact"))


def contact_density(cells: DataFrame, value: str, grid: Grid, bandwidth: float = 1000.0, res: float = 50.0) -> DataFrame:
    return gaussian_density(contact_mask(cells, value), ["contact"], bandwidth / res, grid)


def local_variance_sum(
    cells: DataFrame, columns: Sequence[str], grid: Grid, window: float = 5000.0, res: float = 50.0, name: str = "complexity"
) -> DataFrame:
    """Sum over layers of the variance in an odd square window, scaled to a maximum of 1."""
    size = int(window / res) | 1
    values = cells.select(
        "row",
        "col",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
        *[F.coalesce(F.col(c).cast("double") * F.col(c), F.lit(0.0)).alias(f"_sq_{c}") for c in columns],
    )
    means = separable_filter(values, [*columns, *[f"_sq_{c}" for c in columns]], box_weights(size), grid)
    total = F.lit(0.0)
    for c in columns:
        total = total + F.greatest(F.col(f"_sq_{c}") - F.col(c) * F.col(c), F.lit(0.0))
    return max_normalize(stored(means.select("row", "col", total.alias(name)), "variance"), [name])


def regrid_bilinear(source: DataFrame, source_grid: Grid, target: DataFrame, u: Column, v: Column, value: str = "value") -> DataFrame:
    """Resample `source(row,col,value)` at every row of `target(row,col)`.

    `u`, `v` give the fractional source column and row of a target cell centre, in cell
    units.  The up to four source cells around it are reached by an equi-join; missing ones
    are left out and the weights of the rest rescaled.
    """
    placed = target.select("row", "col", (v - 0.5).alias("_v"), (u - 0.5).alias("_u")).where(
        (F.col("_v") >= -0.5) & (F.col("_v") < source_grid.height - 0.5) & (F.col("_u") >= -0.5) & (F.col("_u") < source_grid.width - 0.5)
    )
    r0, c0 = F.floor("_v"), F.floor("_u")
    fr, fc = F.col("_v") - r0, F.col("_u") - c0
    corners = F.array(
        *[
            F.struct(
                (r0 + dr).alias("_sr"),
                (c0 + dc).alias("_sc"),
                ((fr if dr else 1 - fr) * (fc if dc else 1 - fc)).alias("_w"),
            )
            for dr in (0, 1)
            for dc in (0, 1)
        ]
    )
    wanted = placed.select("row", "col", F.explode(corners).alias("_k")).select("row", "col", "_k.*").where(F.col("_w") > 0)
    known = source.where(F.col(value).isNotNull()).select(
        F.col("row").alias("_sr"), F.col("col").alias("_sc"), F.col(value).cast("double").alias("_val")
    )
    sampled = (
        wanted.join(known, ["_sr", "_sc"])
        .groupBy("row", "col")
        .agg((F.sum(F.col("_w") * F.col("_val")) / F.sum("_w")).alias(value))
    )
    return target.select("row", "col").join(sampled, ["row", "col"], "left")


def regrid(source: DataFrame, source_grid: Grid, target_grid: Grid, target: DataFrame, value: str = "value") -> DataFrame:
    """Bilinear resampling between two frames; unchanged when frame and system are equal.

    A source in geographic degrees is reached through the inverse projection.
    """
    from cellweave.functions.projection import from_utm43n

    if source_grid == target_grid:
        return source.select("row", "col", value)
    x, y = target_grid.x_of(F.col("col")), target_grid.y_of(F.col("row"))
    if source_grid.crs == "EPSG:4326" and target_grid.crs != "EPSG:4326":
        lonlat = from_utm43n(x, y)
        x, y = lonlat["lon"], lonlat["lat"]
    return regrid_bilinear(source, source_grid, target, source_grid.u(x), source_grid.v(y), value)
