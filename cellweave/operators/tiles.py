"""Square tiles over a cell grid.

Where the stride divides the patch size, a tile is a whole number of stride-sized blocks.
Cells are then folded to blocks once (map-side combined) and tiles are put together from
blocks, so overlapping tiles never multiply the cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.lines import map_lines


def tile_origins(extent: int, patch: int, stride: int) -> int:
    """How many top-left origins 0, stride, 2*stride, ... fit."""
    return max(0, (extent - patch) // stride + 1)


def _tiles_over(address: Column, patch: int, stride: int, count: int) -> Column:
    """ARRAY of tile numbers along one axis that cover an address."""
    first = F.greatest(F.ceil((address - patch + 1) / stride).cast("bigint"), F.lit(0))
    last = F.least(F.floor(address / stride).cast("bigint"), F.lit(count - 1))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def tile_cells(cells: DataFrame, height: int, width: int, patch: int, stride: int) -> DataFrame:
    """One row per (tile, cell in it): the cell's columns and the tile's top-left `r, c`."""
    down = _tiles_over(F.col("row"), patch, stride, tile_origins(height, patch, stride))
    across = _tiles_over(F.col("col"), patch, stride, tile_origins(width, patch, stride))
    return (
        cells.withColumn("_tr", F.explode(down)).withColumn("_tc", F.explode(across))
        .withColumn("r", F.col("_tr") * stride).withColumn("c", F.col("_tc") * stride)
        .drop("_tr", "_tc")
    )


def has_content(bands: Sequence[str]) -> Column:
    """1 where the sum over channels (NULL as 0) is not zero."""
    total = F.lit(0.0)
    for b in bands:
        total = total + F.coalesce(F.col(b).cast("double"), F.lit(0.0))
    return (total != 0).cast("bigint")


def tile_aggregate(
    cells: DataFrame, sums: dict[str, Column], height: int, width: int, patch: int, stride: int
) -> DataFrame:
    """`r, c, <sums>`: sums of cell expressions over every tile."""
    named = cells.select("row", "col", *[e.alias(n) for n, e in sums.items()])
    if patch % stride:
        return tile_cells(named, height, width, patch, stride).groupBy("r", "c").agg(*[F.sum(n).alias(n) for n in sums])
    blocks = named.groupBy(
        F.floor(F.col("row") / stride).alias("row"), F.floor(F.col("col") / stride).alias("col")
    ).agg(*[F.sum(n).alias(n) for n in sums])
    span = patch // stride
    down, across = tile_origins(height, patch, stride), tile_origins(width, patch, stride)
    tiles = (
        blocks.withColumn("_tr", F.explode(_tiles_over(F.col("row"), span, 1, down)))
        .withColumn("_tc", F.explode(_tiles_over(F.col("col"), span, 1, across)))
    )
    return tiles.groupBy((F.col("_tr") * stride).alias("r"), (F.col("_tc") * stride).alias("c")).agg(
        *[F.sum(n).alias(n) for n in sums]
    )


def tile_valid_fraction(
    cells: DataFrame, bands: Sequence[str], height: int, width: int, patch: int, stride: int, minimum: float = 0.5
) -> DataFrame:
    """`r, c, valid`: tiles whose share of cells with content reaches `minimum`."""
    counted = tile_aggregate(cells, {"_v": has_content(bands)}, height, width, patch, stride)
    share = F.col("_v") / float(patch * patch)
    return counted.select("r", "c", share.alias("valid")).where(F.col("valid") >= minimum)


def inference_tiles(
    cells: DataFrame, bands: Sequence[str], height: int, width: int, patch: int, stride: int | None = None, minimum: float = 0.3
) -> DataFrame:
    """`row, col, valid`: tile centres half, half+stride, ... below the far edge minus half."""
    half = patch // 2
    tiles = tile_valid_fraction(cells, bands, height, width, patch, stride or half, minimum)
    centres = tiles.select((F.col("r") + half).alias("row"), (F.col("c") + half).alias("col"), "valid")
    return centres.where((F.col("row") < height - half) & (F.col("col") < width - half))


def patch_channel_mean(cells: DataFrame, bands: Sequence[str], height: int, width: int, patch: int, stride: int) -> DataFrame:
    """`r, c, <bands>`: mean of each channel (NULL as 0) over each tile."""
    sums = {b: F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in bands}
    total = tile_aggregate(cells, sums, height, width, patch, stride)
    return total.select("r", "c", *[(F.col(b) / float(patch * patch)).alias(b) for b in bands])


def tile_overlap_mean(tiles: DataFrame, columns: Sequence[str], height: int, width: int, patch: int, stride: int) -> DataFrame:
    """`row, col, n_tiles, <columns>`: mean over the tiles that cover a cell, NULL if none.

    `tiles` has the centre as `row, col`.  Where all tiles lie on the grid of the stride, the accumulation runs on blocks
    and only the result is unrolled to cells.  Tiles with any other centre go through a difference grid.
    """
    half = patch // 2
    top, left = F.col("row") - half, F.col("col") - half
    step = math.gcd(stride, patch)
    off = F.max((F.pmod(top, F.lit(step)) != 0) | (F.pmod(left, F.lit(step)) != 0))
    if step == 1 or tiles.agg(off).first()[0]:
        return _overlap_by_differences(tiles, columns, height, width, patch)
    covered = (
        tiles.withColumn("_br", F.explode(F.sequence(F.floor(top / step), F.floor((top + patch - 1) / step))))
        .withColumn("_bc", F.explode(F.sequence(F.floor(left / step), F.floor((left + patch - 1) / step))))
        .groupBy("_br", "_bc")
        .agg(F.count("*").alias("n_tiles"), *[F.avg(c).alias(c) for c in columns])
    )
    spark = tiles.sparkSession
    rows, cols = -(-height // step), -(-width // step)
    frame = spark.range(rows * cols).select(
        F.expr(f"id div {cols}").alias("_br"), (F.col("id") % cols).alias("_bc")
    )
    filled = frame.join(covered, ["_br", "_bc"], "left")
    inside = F.explode(F.sequence(F.lit(0), F.lit(step - 1)))
    return (
        filled.withColumn("_dr", inside).withColumn("_dc", inside)
        .withColumn("row", F.col("_br") * step + F.col("_dr")).withColumn("col", F.col("_bc") * step + F.col("_dc"))
        .where((F.col("row") < height) & (F.col("col") < width))
        .select("row", "col", F.coalesce("n_tiles", F.lit(0)).cast("bigint").alias("n_tiles"), *columns)
    )


def _overlap_by_differences(tiles: DataFrame, columns: Sequence[str], height: int, width: int, patch: int) -> DataFrame:
    """The same for centres anywhere: four signed corners a tile, then running sums along rows and along columns.

    A tile costs four rows whatever its size.  Values are taken relative to the column's mean over all tiles, so that
    the sums stay small and little is lost when they cancel.
    """
    middle = tiles.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    top, left = F.col("row") - patch // 2, F.col("col") - patch // 2
    lines = {"_t": F.greatest(top, F.lit(0)), "_b": F.least(top + patch, F.lit(height)), "_l": F.greatest(left, F.lit(0)), "_r": F.least(left + patch, F.lit(width))}
    corners = [F.struct(F.col(r).cast("bigint").alias("row"), F.col(c).cast("bigint").alias("col"), F.lit(s).alias("_s")) for r, c, s in (("_t", "_l", 1), ("_t", "_r", -1), ("_b", "_l", -1), ("_b", "_r", 1))]
    clipped = tiles.select(*[F.col(c).cast("double").alias(c) for c in columns], *[e.alias(n) for n, e in lines.items()]).where("_t < _b and _l < _r")
    marked = clipped.select(*columns, F.inline(F.array(*corners))).where((F.col("row") < height) & (F.col("col") < width))
    sums = {"_n": F.sum("_s")}
    for i, c in enumerate(columns):
        sums[f"_n{i}"] = F.sum(F.when(F.col(c).isNotNull(), F.col("_s")))
        sums[f"_v{i}"] = F.sum(F.col("_s") * (F.col(c) - F.lit(middle[c])))
    grid = marked.groupBy("row", "col").agg(*[e.alias(n) for n, e in sums.items()])
    frame = tiles.sparkSession.range(height * width).select(F.expr(f"id div {width}").alias("row"), (F.col("id") % width).alias("col"))
    names = list(sums)

    def run(*planes: np.ndarray) -> list[np.ndarray]:
        return [np.cumsum(np.nan_to_num(p), axis=1) for p in planes]

    across = map_lines(frame.join(grid, ["row", "col"], "left"), "row", width, run, names, names)
    total = map_lines(across, "col", height, run, names, names)
    known = [F.round(f"_n{i}") for i in range(len(columns))]
    means = [F.when(k > 0, F.col(f"_v{i}") / k + F.lit(middle[c])).alias(c) for i, (c, k) in enumerate(zip(columns, known))]
    return total.select("row", "col", F.round("_n").cast("bigint").alias("n_tiles"), *means)


def depth_ensemble_mean(columns: Sequence[str]) -> Column:
    """Row-wise mean of the depth columns that are known."""
    known = F.array_compact(F.array(*[F.col(c) for c in columns]))
    total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def mc_mean_std(passes: DataFrame, keys: Sequence[str], score: str = "prob") -> DataFrame:
    """Mean and sample deviation over stochastic passes."""
    return passes.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))


def pass_mean_std(passes: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of an ARRAY of passes, inside the row."""
    n = F.size(passes)
    mean = F.aggregate(passes, F.lit(0.0), lambda s, p: s + p) / n
    squares = F.aggregate(F.transform(passes, lambda p: (p - mean) * (p - mean)), F.lit(0.0), lambda s, d: s + d)
    return mean, F.when(n > 1, F.sqrt(squares / (n - 1)))


def random_token_mask(tokens: DataFrame, tile: str, position: str, per_tile: int, ratio: float = 0.75, seed: int = 42) -> DataFrame:
    """Add `masked`: all but int(per_tile * (1 - ratio)) tokens of each tile, chosen by hash.

    A tile has a fixed, small number of tokens, so the ranking window is bounded.
    """
    from pyspark.sql import Window

    keep = int(per_tile * (1 - ratio))
    order = Window.partitionBy(tile).orderBy(F.md5(F.concat_ws("-", tile, position, F.lit(seed))), position)
    return tokens.withColumn("masked", (F.row_number().over(order) > keep).cast("int"))


def masked_mse(tokens: DataFrame, error: str = "error", masked: str = "masked") -> DataFrame:
    """One row: sum of masked token errors over the number of masked tokens (+1e-8)."""
    return tokens.agg((F.sum(F.col(error) * F.col(masked)) / (F.sum(masked) + 1e-8)).alias("loss"))
