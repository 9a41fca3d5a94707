"""Grids, points, lines and tiles derived from the sample tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.catalog.registry import R
from cellweave.functions.scalars import clip
from cellweave.grid import Grid
from cellweave.operators.labels import fold_strips
from cellweave.scale import broadcast_if_small
from cellweave.session import stored

WIDTH = 100
PART_WIDTH = 50
BANDS = ["b1", "b2", "b3", "b4", "b5"]
FOLD_BUFFER = 5
PATCH, STRIDE = 8, 4
#: Customers that are sent whole to every executor, some 45 bytes each; more meet their orders by sort and merge.
CUSTOMER_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cell_grid(spark: SparkSession, folder: str) -> Grid:
    last = table(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0]
    return Grid.of_shape(last // WIDTH + 1, WIDTH)


def part_grid(spark: SparkSession, folder: str) -> Grid:
    last = table(spark, folder, "part").agg(F.max("p_partkey")).first()[0]
    return Grid.of_shape(last // PART_WIDTH + 1, PART_WIDTH)


_STORED: dict[tuple[str, str], str] = {}


def stored_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cell table written once per application, for jobs that scan it several times."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:  # the shared folder was emptied in between
            del _STORED[key]
    written = stored(cells(spark, folder), "cells")
    _STORED[key] = written.inputFiles()[0].rsplit("/", 1)[0]
    return written


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """One cell per order; bands from its price, lines and customer."""
    orders = table(spark, folder, "orders")
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.round(F.sum("l_quantity"), 6).alias("b2"),
            F.round(F.min("l_discount"), 6).alias("b3"),
            F.round(F.avg("l_tax"), 6).alias("b4"),
            F.max(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45), 1).otherwise(0)).alias("label"),
        )
    )
    customers = table(spark, folder, "customer").select("c_custkey", F.round("c_acctbal", 6).alias("b5"))
    priorities = orders.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p")).scalar()  # five classes
    placed = orders.select(
        "o_orderkey",
        "o_custkey",
        F.expr(f"o_orderkey div {WIDTH}").alias("row"),
        (F.col("o_orderkey") % WIDTH).alias("col"),
        F.array_position(priorities, F.col("o_orderpriority")).cast("bigint").alias("b0"),
        F.round("o_totalprice", 6).alias("b1"),
        (F.col("o_totalprice") > 495000).alias("fault"),
    )
    customers = broadcast_if_small(customers, limit=CUSTOMER_ROWS)
    joined = placed.join(lines, placed["o_orderkey"] == lines["l_orderkey"], "left").join(
        customers, placed["o_custkey"] == customers["c_custkey"], "left"
    )
    return joined.select(
        "row", "col", "b0", "b1", "b2", "b3", "b4", "b5", "fault", F.coalesce("label", F.lit(0)).cast("bigint").alias("label")
    )


CELLS_SQL = f"""
line_bands AS (
  SELECT l_orderkey, round(sum(l_quantity), 6) AS b2, round(min(l_discount), 6) AS b3, round(avg(l_tax), 6) AS b4,
         max(CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 1 ELSE 0 END) AS label
  FROM lineitem GROUP BY l_orderkey),
cells AS (
  SELECT CAST(o_orderkey // {WIDTH} AS BIGINT) AS row, CAST(o_orderkey % {WIDTH} AS BIGINT) AS col,
         CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS BIGINT) AS b0, round(o_totalprice, 6) AS b1,
         b2, b3, b4, round(c_acctbal, 6) AS b5, o_totalprice > 495000 AS fault,
         CAST(coalesce(label, 0) AS BIGINT) AS label
  FROM orders LEFT JOIN line_bands ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
dim AS (SELECT max("row") + 1 AS h, {WIDTH} AS w FROM cells)"""

LONG_SQL = (
    CELLS_SQL
    + """,
cells_long AS (
  SELECT row, col, band, value FROM cells
  UNPIVOT INCLUDE NULLS (value FOR band IN (b1, b2, b3, b4, b5)))"""
)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.expr(f"p_partkey div {PART_WIDTH}").alias("row"),
        (F.col("p_partkey") % PART_WIDTH).alias("col"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("kind"),
    )


PARTS_SQL = f"""
parts AS (
  SELECT CAST(p_partkey // {PART_WIDTH} AS BIGINT) AS row, CAST(p_partkey % {PART_WIDTH} AS BIGINT) AS col,
         CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, p_type AS kind FROM part),
pdim AS (SELECT max("row") + 1 AS h, {PART_WIDTH} AS w FROM parts)"""


def points(spark: SparkSession, folder: str, grid: Grid) -> DataFrame:
    """One occurrence per customer."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        ((F.col("c_acctbal") + 1000) / 11000 * (WIDTH * 50.0)).alias("x"),
        ((F.col("c_custkey") * 37) % (grid.height * 50)).cast("double").alias("y"),
        F.col("c_mktsegment").alias("segment"),
    )


POINTS_SQL = f"""
points AS (
  SELECT c_custkey AS id, (c_acctbal + 1000) / 11000 * ({WIDTH} * 50.0::DOUBLE) AS x,
         CAST((c_custkey * 37) % (h * 50) AS DOUBLE) AS y, c_mktsegment AS segment
  FROM customer, dim)"""


def lines(spark: SparkSession, folder: str, grid: Grid) -> DataFrame:
    """One short two-vertex line per event; some leave the grid."""
    x0 = F.col("value") * 10.0 + 3.7
    y0 = (F.col("event_id") * 131) % (grid.height * 50) + 11.3
    x1 = x0 + ((F.col("user_id") * 13 + F.col("event_id") * 7) % 900 - 450) + 0.19
    y1 = y0 + ((F.col("event_id") * 29) % 700 - 350) + 0.23

    def vertex(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return table(spark, folder, "events").select(
        F.col("event_id").alias("feature_id"),
        F.col("event_type").alias("kind"),
        F.struct(F.lit("LineString").alias("type"), F.array(F.array(vertex(x0, y0), vertex(x1, y1))).alias("parts")).alias("geom"),
    )


LINES_SQL = """
line_starts AS (
  SELECT event_id AS feature_id, event_type AS kind, user_id, event_id, value * 10.0::DOUBLE + 3.7::DOUBLE AS x0,
         CAST((event_id * 131) % (h * 50) AS DOUBLE) + 11.3::DOUBLE AS y0
  FROM events, dim),
lines AS (
  SELECT feature_id, kind, x0, y0,
         x0 + CAST((user_id * 13 + event_id * 7) % 900 - 450 AS DOUBLE) + 0.19::DOUBLE AS x1,
         y0 + CAST((event_id * 29) % 700 - 350 AS DOUBLE) + 0.23::DOUBLE AS y1
  FROM line_starts)"""


def boxes(spark: SparkSession, folder: str, grid: Grid) -> DataFrame:
    """One rectangle per nation on a 5 x 5 raster, overlapping its neighbours."""
    w, h = WIDTH * 50 / 5, grid.height * 50 / 5
    left = (F.col("n_nationkey") % 5) * w + 13.1
    low = F.expr("n_nationkey div 5") * h + 17.3
    right, high = left + w * 1.1, low + h * 1.1

    def vertex(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    ring = F.array(vertex(left, low), vertex(right, low), vertex(right, high), vertex(left, high), vertex(left, low))
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("feature_id"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("parts")).alias("geom"),
    )


BOXES_SQL = """
box_corners AS (
  SELECT CAST(n_nationkey AS BIGINT) AS feature_id, 'R' || n_regionkey AS category, w * 50.0::DOUBLE / 5 AS bw, h * 50.0::DOUBLE / 5 AS bh,
         (n_nationkey % 5) * (w * 50.0::DOUBLE / 5) + 13.1::DOUBLE AS x0, (n_nationkey // 5) * (h * 50.0::DOUBLE / 5) + 17.3::DOUBLE AS y0
  FROM nation, dim),
boxes AS (SELECT feature_id, category, x0, y0, x0 + bw * 1.1::DOUBLE AS x1, y0 + bh * 1.1::DOUBLE AS y1 FROM box_corners)"""


def strips(grid: Grid):
    return fold_strips(grid.width, 5, FOLD_BUFFER)


FOLDS_SQL = f"""
folds AS (
  SELECT k AS fold, k * 20 AS s, (k + 1) * 20 AS e, greatest(0, k * 20 - {FOLD_BUFFER}) AS tl,
         least({WIDTH}, (k + 1) * 20 + {FOLD_BUFFER}) AS tr
  FROM (SELECT unnest(range(0, 5)) AS k)),
fold_cells AS (
  SELECT c.*, fold, CASE WHEN col >= s AND col < e THEN 'test' ELSE 'train' END AS region
  FROM cells c JOIN folds ON (col >= s AND col < e) OR col < tl OR col >= tr)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with a simple score that has many ties."""
    score = clip(F.coalesce("b2", F.lit(0.0)) / 350.0, 0.0, 1.0)
    return stored_cells(spark, folder).select("row", "col", "label", F.round(score, 4).alias("score"))


SCORED_SQL = (
    CELLS_SQL
    + f""",
scored AS (SELECT row, col, label, {R("least(1.0, greatest(0.0, coalesce(b2, 0) / 350.0::DOUBLE))", 4)} AS score FROM cells)"""
)


def passes(spark: SparkSession, folder: str) -> DataFrame:
    """Ten perturbed copies of the score per cell."""
    base = scored(spark, folder)
    k = F.explode(F.sequence(F.lit(0), F.lit(9)))
    wobble = (F.col("row") * 7 + F.col("col") * 13 + F.col("pass") * 31) % 17 - 8
    return base.withColumn("pass", k).select("row", "col", "pass", (F.col("score") + 0.01 * wobble).alias("prob"))


PASSES_SQL = (
    SCORED_SQL
    + """,
passes AS (
  SELECT row, col, pass, score + 0.01::DOUBLE * ((row * 7 + col * 13 + pass * 31) % 17 - 8) AS prob
  FROM scored, (SELECT unnest(range(0, 10)) AS pass))"""
)


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events per user and day as a training log: run = user, epoch = day."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").cast("bigint").alias("epoch"))
        .agg(F.round(F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / (F.count("*") * 61300.0), 6).alias("auc_pr"))
    )


RUNS_SQL = """
run_log AS (
  SELECT user_id AS run, CAST(day(ts) AS BIGINT) AS epoch,
         round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 61300.0::DOUBLE), 6) AS auc_pr
  FROM events GROUP BY 1, 2)"""


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "source")


#: Terms that occur in the sample texts, in two categories.
DOC_TERMS = {"common": ["the", "tion", "and.*the"], "romance": ["ou", "que", "ment"], "german": ["sch", "ein"]}
DOC_SHEETS = ["SRC3", "SRC7", "SRC1"]


def patches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("patch"))


PATCHES_SQL = "patches AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS patch FROM embeddings)"
