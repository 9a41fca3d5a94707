"""The raster frame: bounds, shape and the coordinate arithmetic on it."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """North-up frame; cell (0, 0) is the upper left one."""

    minx: float
    miny: float
    maxx: float
    maxy: float
    width: int
    height: int
    crs: str = "EPSG:32643"

    @property
    def xres(self) -> float:
        return (self.maxx - self.minx) / self.width

    @property
    def yres(self) -> float:
        return (self.maxy - self.miny) / self.height

    @classmethod
    def of_shape(cls, height: int, width: int, res: float = 50.0) -> Grid:
        return cls(0.0, 0.0, width * res, height * res, width, height)

    @classmethod
    def of_extent(cls, row) -> Grid:
        """From the one row that `study_extent` gives."""
        return cls(row["minx"], row["miny"], row["maxx"], row["maxy"], row["width_px"], row["height_px"])

    def as_dict(self) -> dict:
        return asdict(self)

    def u(self, x: Column) -> Column:
        """Fractional column."""
        return (x - self.minx) / self.xres

    def v(self, y: Column) -> Column:
        """Fractional row, growing southwards."""
        return (self.maxy - y) / self.yres

    def col_of(self, x: Column) -> Column:
        return F.floor(self.u(x))

    def row_of(self, y: Column) -> Column:
        return F.floor(self.v(y))

    def x_of(self, col: Column) -> Column:
        return self.minx + (col + 0.5) * self.xres

    def y_of(self, row: Column) -> Column:
        return self.maxy - (row + 0.5) * self.yres

    def has(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)

    def has_xy(self, x: Column, y: Column) -> Column:
        return x.between(self.minx, self.maxx) & y.between(self.miny, self.maxy)


def world_to_pixel(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Add `row`, `col` of the cell under each point (may lie outside the grid)."""
    return points.withColumn("row", grid.row_of(F.col(y))).withColumn("col", grid.col_of(F.col(x)))


def study_extent(bounds: DataFrame, res: float = 50.0, crs: str = "EPSG:32643") -> DataFrame:
    """Intersection of all layer bounds (`minx,miny,maxx,maxy` per layer), one row."""
    box = bounds.agg(
        F.max("minx").alias("minx"), F.max("miny").alias("miny"), F.min("maxx").alias("maxx"), F.min("maxy").alias("maxy")
    )
    spanx, spany = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return box.select(
        F.lit(crs).alias("crs"),
        "minx", "miny", "maxx", "maxy",
        (spanx * spany / 1e6).alias("area_km2"),
        (spanx / res).cast("int").alias("width_px"),
        (spany / res).cast("int").alias("height_px"),
        F.lit(float(res)).alias("resolution_m"),
    )


def grid_cells(spark, grid: Grid) -> DataFrame:
    """All addresses of a grid; made by `range`, so it is as distributed as the session allows."""
    return spark.range(grid.height * grid.width).select(
        F.expr(f"id div {grid.width}").alias("row"), (F.col("id") % grid.width).alias("col")
    )
