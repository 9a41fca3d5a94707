"""Raster bands as cell tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentinel of float layers at the edge of the engine; NULL inside it.
NODATA = -9999.0
#: Sentinel of label and mask layers.
LABEL_NODATA = 255


def nodata_to_null(cells: DataFrame, columns: Sequence[str], nodata: float | None = NODATA) -> DataFrame:
    """Sentinel and NaN become NULL, for statistics that must skip unknown cells."""

    def clean(name: str) -> Column:
        v = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        return v if nodata is None else F.when(v != float(nodata), v)

    return cells.select(*[clean(c).alias(c) if c in columns else F.col(c) for c in cells.columns])


def nodata_to_zero(cells: DataFrame, columns: Sequence[str], nodata: float = NODATA) -> DataFrame:
    """Sentinel, NaN and NULL become 0, for tiles."""
    known = nodata_to_null(cells, columns, nodata)
    return known.na.fill(0.0, list(columns))


def null_to_nodata(cells: DataFrame, columns: Sequence[str], nodata: float = NODATA) -> DataFrame:
    return cells.select(
        *[F.coalesce(F.col(c), F.lit(float(nodata))).cast("float").alias(c) if c in columns else F.col(c) for c in cells.columns]
    )


def write_bands(long: DataFrame, path: str, nodata: float | None = NODATA, rows_per_block: int = 4096) -> None:
    """Write `row, col, band, value` as float32, one folder per band and block of rows.

    `row_block` lets a reader prune to a strip; `nodata=None` keeps NULL (as NaN layers do).
    Rows are clustered by folder first, so a task writes few files.
    """
    value = F.col("value") if nodata is None else F.coalesce(F.col("value"), F.lit(float(nodata)))
    blocked = long.select("row", "col", value.cast("float").alias("value"), "band", F.floor(F.col("row") / rows_per_block).alias("row_block"))
    blocked.hint("rebalance", "band", "row_block").write.mode("overwrite").partitionBy("band", "row_block").parquet(path)


def read_bands(spark: SparkSession, path: str, nodata: float | None = NODATA) -> DataFrame:
    """Long cell table written by `write_bands`."""
    long = spark.read.parquet(path).select("row", "col", "band", F.col("value").cast("double").alias("value"))
    return nodata_to_null(long, ["value"], nodata)


def band_range(long: DataFrame) -> DataFrame:
    """Smallest and largest value per band, as reported when a layer is saved."""
    return long.groupBy("band").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def assemble_bands(source: DataFrame, bands: dict[str, int], nodata: float | None = None) -> DataFrame:
    """Named bands from a long multiband table by band index; the sentinel defaults to -9999."""
    chosen = source.where(F.col("band").isin(list(bands.values())))
    wide = chosen.groupBy("row", "col").agg(
        *[F.max(F.when(F.col("band") == i, F.col("value"))).alias(name) for name, i in bands.items()]
    )
    return nodata_to_null(wide, list(bands), NODATA if nodata is None else nodata)


def assemble_single_bands(sources: dict[str, DataFrame], nodata: float | None = None) -> DataFrame:
    """Named bands from one `row, col, value` table each; all use the sentinel of the first."""
    frames = [df.select("row", "col", F.col("value").alias(name)) for name, df in sources.items()]
    wide = reduce(lambda a, b: a.join(b, ["row", "col"]), frames)
    return nodata_to_null(wide, list(sources), NODATA if nodata is None else nodata)


def raster_profile(long: DataFrame, layers: Sequence[str], res: float) -> DataFrame:
    """Per layer: bands, width, height, resolution, bounds and number of unknown cells.

    `long` has `row, col, band, value` and map coordinates `x, y` of the cell centres.
    """
    half = res / 2
    return long.groupBy(*layers).agg(
        F.count_distinct("band").alias("bands"),
        (F.max("col") + 1).alias("width"),
        (F.max("row") + 1).alias("height"),
        F.lit(round(res, 2)).alias("res_x"),
        F.lit(round(res, 2)).alias("res_y"),
        F.round(F.min("x") - half, 4).alias("minx"),
        F.round(F.min("y") - half, 4).alias("miny"),
        F.round(F.max("x") + half, 4).alias("maxx"),
        F.round(F.max("y") + half, 4).alias("maxy"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
    )
