"""Queries: what sinks write is read back by the sources, on content of the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.catalog import fixtures as fx
from cellweave.catalog.registry import R, query, rounded
from cellweave.operators import normalize
from cellweave.operators.geometry import centroid
from cellweave.session import scratch_path
from cellweave.sources import inventory, rasters, runs, vectors


@query("s5_json_summary_sink", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_custkey), 4) + 0.0::DOUBLE AS mean FROM customer GROUP BY 1")
def s5(spark, folder):
    summary = fx.table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), rounded(F.avg("c_custkey"), 4).alias("mean"))
    path = scratch_path(spark, "summary")
    inventory.write_summary(summary, path)
    return spark.read.schema("segment string, n bigint, mean double").json(path)


@query("s14_manifest_sinks", "SELECT p_brand AS channel, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def s14(spark, folder):
    manifest = fx.table(spark, folder, "part").groupBy(F.col("p_brand").alias("channel")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    path = scratch_path(spark, "manifest")
    inventory.write_manifest(manifest, path)
    return spark.read.schema("channel string, n bigint, first bigint").json(path)


@query(
    "s10_csv_points",
    f"""SELECT c_custkey AS id, {R('70 + c_custkey % 1000 / 100.0::DOUBLE', 4)} AS x, {R('10 + c_nationkey / 10.0::DOUBLE', 4)} AS y
    FROM customer WHERE c_custkey % 7 <> 0""",
)
def s10(spark, folder):
    """Points of a CSV file with coordinates under usual names; lines without a number have no geometry."""
    lon = F.format_string("%.4f", 70 + F.col("c_custkey") % 1000 / 100.0)
    written = fx.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise(lon).alias("Longitude"), (10 + F.col("c_nationkey") / 10.0).alias("lat")
    )
    path = scratch_path(spark, "points")
    written.write.option("header", True).csv(path)
    found = vectors.read_csv_points(spark, path, project=False).where("geom is not null")
    spot = centroid(F.col("geom"))
    return found.select(F.col("id").cast("bigint").alias("id"), rounded(spot["x"], 4).alias("x"), rounded(spot["y"], 4).alias("y"))


@query(
    "s16_resolve_column",
    "SELECT p_partkey AS id, p_type AS lithology, p_brand AS deposit FROM part",
)
def s16(spark, folder):
    """Columns found by their usual names, whatever else the table holds."""
    layer = fx.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.lit("x").alias("geom"), F.col("p_name").alias("uniform"), F.col("p_type").alias("ROCK_TYPE"), F.col("p_brand").alias("commodity")
    )
    return layer.select("id", F.col(vectors.lithology_column(layer)).alias("lithology"), vectors.deposit_column(layer, "kind").alias("deposit"))


@query(
    "s17_per_file_error_isolation",
    """SELECT 'good' AS part, 4::BIGINT AS n_files, 4::BIGINT AS n_ok, (SELECT count(*) FROM orders) AS n_rows
    UNION ALL SELECT 'bad', 1, 0, 0""",
)
def s17(spark, folder):
    """Files of orders with a broken one among them: the others are read, and the broken one is named."""
    orders = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    good, bad = scratch_path(spark, "layers-good"), scratch_path(spark, "layers-bad")
    for k in range(4):
        orders.where(F.col("o_orderkey") % 4 == k).coalesce(1).write.parquet(f"{good}/{k}")
    fx.table(spark, folder, "orders").select(F.col("o_orderkey").cast("string")).coalesce(1).write.text(bad)
    paths = [*[f"{good}/{k}" for k in range(4)], bad]
    status = vectors.file_status(spark, paths, schema="o_orderkey bigint, o_custkey bigint")
    part = F.when(F.col("path").contains("layers-bad"), "bad").otherwise("good")
    return status.groupBy(part.alias("part")).agg(F.count("*").alias("n_files"), F.count_if("ok").alias("n_ok"), F.sum("n_rows").alias("n_rows"))


@query(
    "s1_file_inventory",
    """WITH files AS (SELECT DISTINCT 'set' || (o_custkey % 2) AS dataset, o_orderkey % 3 AS ending, o_orderkey % 11 AS g FROM orders)
    SELECT dataset, count(*) AS n_files, count(*) FILTER (WHERE ending = 0) AS n_rasters, count(*) FILTER (WHERE ending = 1) AS n_vectors FROM files GROUP BY 1""",
)
def s1(spark, folder):
    """The listing of files with several endings, written into two folders."""
    root = scratch_path(spark, "inventory")
    orders = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 11).alias("g"))
    for j in range(2):
        for k, ending in enumerate(("tif", "shp", "csv")):
            part = orders.where((F.col("o_custkey") % 2 == j) & (F.col("o_orderkey") % 3 == k))
            part.repartition(1).write.partitionBy("g").option("extension", ending).csv(f"{root}/set{j}/{ending}")
    return inventory.inventory_counts(inventory.file_inventory(spark, root))


@query("s18_metrics_files", f"WITH {fx.RUNS_SQL} SELECT run, epoch, auc_pr FROM run_log")
def s18(spark, folder):
    """Run documents written as files and read back epoch by epoch."""
    nested = fx.run_log(spark, folder).groupBy("run").agg(F.collect_list(F.struct("epoch", "auc_pr")).alias("log"))
    path = scratch_path(spark, "runs")
    runs.write_metrics(nested, path, "run")
    return runs.read_epochs(spark, path, "run", schema=nested.schema).select("run", "epoch", "auc_pr")


@query("s19_csv_files", f"WITH {fx.CELLS_SQL} SELECT row, col, printf('%.4f', b5) AS b5 FROM cells")
def s19(spark, folder):
    path = scratch_path(spark, "cells-csv")
    inventory.write_csv(fx.cells(spark, folder).select("row", "col", "b5"), path)
    return spark.read.option("header", True).schema("row bigint, col bigint, b5 string").csv(path)


@query("s8_band_files", f"WITH {fx.LONG_SQL} SELECT row, col, band, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM cells_long")
def s8(spark, folder):
    """Bands written with nodata values and read back with nulls."""
    path = scratch_path(spark, "bands")
    rasters.write_bands(normalize.unpivot_bands(fx.cells(spark, folder), fx.BANDS), path)
    return rasters.read_bands(spark, path)
