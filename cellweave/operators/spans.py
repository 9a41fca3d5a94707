"""Spans: what a shape covers in one grid row, as an interval of columns (`row, lo, hi`, both ends in).

Discs, outlines and fills become spans first, as many as shapes have rows. Spans that overlap or
adjoin are merged by a sweep along the row, and only the merged ones are unrolled to cells, so that
the rows before the last step do not grow with the area of a shape or with how many lie on each other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.grid import Grid


def merged_spans(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`keys..., row, lo, hi`: spans of one key and row that overlap or adjoin become one.

    Spans that begin at the same column are folded by a map-side-combined aggregate before the sweep,
    so one (key, row) never brings more rows to its task than the grid has columns. Empty spans
    (`lo > hi` or null ends) take no part; a null key is a key like any other.
    """
    by = [*keys, "row"]
    starts = spans.where(F.col("lo") <= F.col("hi")).groupBy(*by, "lo").agg(F.max("hi").alias("hi"))
    along = Window.partitionBy(*by).orderBy("lo")
    reached = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("lo") > reached + 1, 1).otherwise(0)
    runs = starts.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(along))
    return runs.groupBy(*by, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def unrolled(spans: DataFrame) -> DataFrame:
    """Each span as its cells: `col` instead of `lo, hi`."""
    rest = [c for c in spans.columns if c not in ("lo", "hi")]
    return spans.where(F.col("lo") <= F.col("hi")).select(*rest, F.explode(F.sequence("lo", "hi")).alias("col"))


def disc_spans(points: DataFrame, grid: Grid, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """`row, lo, hi`: the columns whose cells come within `radius` of a point, one span a point and row.

    The half chord gives both ends up to rounding; each end is then put right by the distance test
    itself, so a cell that is touched exactly at the radius belongs to the disc.
    """
    reach = math.floor(radius / grid.yres) + 1
    reach_c = math.floor(radius / grid.xres) + 1
    px, py = F.col("_x"), F.col("_y")
    rows = (
        points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .withColumn("_r", grid.row_of(py)).withColumn("_c", grid.col_of(px))
        .where(F.col("_r").between(-reach, grid.height - 1 + reach) & F.col("_c").between(-reach_c, grid.width - 1 + reach_c))
        .withColumn("row", F.explode(F.sequence(F.greatest(F.col("_r") - reach, F.lit(0)), F.least(F.col("_r") + reach, F.lit(grid.height - 1)))))
    )
    top, bottom = grid.maxy - F.col("row") * grid.yres, grid.maxy - (F.col("row") + 1) * grid.yres
    dy = F.greatest(bottom - py, py - top, F.lit(0.0))
    rest = radius * radius - dy * dy

    def bound(df: DataFrame, *columns: Column) -> DataFrame:
        """Columns bound by a generator: later expressions read them instead of repeating their work."""
        return df.select("_x", "_y", "row", F.inline(F.array(F.struct(*columns))))

    chords = bound(rows, (dy * dy).alias("_dy2"), rest.alias("_rest")).where("_rest >= 0")
    half = F.sqrt("_rest")

    def within(col: Column) -> Column:
        left, right = grid.minx + col * grid.xres, grid.minx + (col + 1) * grid.xres
        dx = F.greatest(left - px, px - right, F.lit(0.0))
        return dx * dx + F.col("_dy2") <= radius * radius

    ends = bound(chords, F.col("_dy2"), grid.col_of(px - half).alias("_lo"), grid.col_of(px + half).alias("_hi"))
    low, high = F.col("_lo"), F.col("_hi")
    low = F.when(within(low - 1), low - 1).when(within(low), low).otherwise(low + 1)
    high = F.when(within(high + 1), high + 1).when(within(high), high).otherwise(high - 1)
    held = bound(ends, F.greatest(low, F.lit(0)).alias("lo"), F.least(high, F.lit(grid.width - 1)).alias("hi"))
    return held.select("row", "lo", "hi").where(F.col("lo") <= F.col("hi"))
