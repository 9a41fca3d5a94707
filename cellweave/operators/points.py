"""Occurrence points against the cell table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.grid import Grid, world_to_pixel
from cellweave.scale import broadcast_if_small


def point_window_median(
    points: DataFrame, cells: DataFrame, bands: Sequence[str], grid: Grid, buffer_px: int = 2, key: str = "id"
) -> DataFrame:
    """Add, per band, the median of the known cells within `buffer_px` of each point.

    Points of one cell share their window, so each cell with points is unrolled into window offsets once.
    When these are checked to be few they are broadcast and the cells are only filtered, not shuffled; many points
    meet their cells by sort and merge, so nothing on the driver grows with them.  Points without any known cell keep NULL.
    """
    placed = world_to_pixel(points, grid).select(key, F.col("row").alias("_row"), F.col("col").alias("_col"))
    spots = placed.select("_row", "_col").distinct()
    window = (2 * buffer_px + 1) ** 2
    around = F.sequence(F.lit(-buffer_px), F.lit(buffer_px))
    wanted = (
        spots.withColumn("_dr", F.explode(around)).withColumn("_dc", F.explode(around))
        .select("_row", "_col", (F.col("_row") + F.col("_dr")).alias("row"), (F.col("_col") + F.col("_dc")).alias("col"))
        .where(grid.has(F.col("row"), F.col("col")))
    )
    medians = (
        cells.select("row", "col", *bands)
        .join(broadcast_if_small(wanted, points, window), ["row", "col"])
        .groupBy("_row", "_col")
        .agg(*[F.percentile(F.col(b).cast("double"), 0.5).alias(b) for b in bands])  # (2*buffer_px+1)^2 values at most
    )
    of_points = broadcast_if_small(placed, points, window).join(medians, ["_row", "_col"]).drop("_row", "_col")
    return points.join(broadcast_if_small(of_points, points, window), key, "left")


def occurrence_scores(points: DataFrame, cells: DataFrame, score: str, grid: Grid) -> DataFrame:
    """Points inside the grid with the known score of the cell under them.

    Only the addresses of the cells with points are broadcast, and only when they are checked to be few.
    """
    placed = world_to_pixel(points, grid).where(grid.has(F.col("row"), F.col("col")))
    spots = broadcast_if_small(placed.select("row", "col").distinct(), points)
    known = cells.where(F.col(score).isNotNull()).select("row", "col", score).join(spots, ["row", "col"])
    return broadcast_if_small(placed, points).join(known, ["row", "col"])
