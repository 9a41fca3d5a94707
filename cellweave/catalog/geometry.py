"""Queries: projection, geometry, rasterisation, buffers, extents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.catalog import fixtures as fx
from cellweave.catalog.registry import R, query, round_columns, rounded
from cellweave.functions import projection
from cellweave.grid import Grid, study_extent, world_to_pixel
from cellweave.operators import geometry as geo
from cellweave.plans.labelling import label_cells
from cellweave.session import scratch_path
from cellweave.sources.vectors import point_geometry


def _forward_sql() -> str:
    e = repr(projection.ECCENTRIC)
    x = " + ".join(["eta"] + [f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(projection.FORWARD, 1)])
    y = " + ".join(["xi"] + [f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(projection.FORWARD, 1)])
    k = repr(projection.SCALE * projection.RECTIFYING_RADIUS)
    return f"""lonlat AS (
      SELECT c_custkey AS id, 73.0::DOUBLE + (c_acctbal + 1000) / 11000 * 4 AS lon, 12.0::DOUBLE + (c_custkey * 37 % 5000) / 1000.0::DOUBLE AS lat FROM customer),
    conformal AS (SELECT id, radians(lon - 75) AS dl, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t FROM lonlat),
    angles AS (SELECT id, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM conformal)
    SELECT id, {R(f'500000 + {k} * ({x})', 3)} AS x, {R(f'{k} * ({y})', 3)} AS y FROM angles"""


def lonlat(spark, folder):
    return fx.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        (73.0 + (F.col("c_acctbal") + 1000) / 11000 * 4).alias("lon"),
        (12.0 + (F.col("c_custkey") * 37 % 5000) / 1000.0).alias("lat"),
    )


@query("c1_to_utm43n", f"WITH {_forward_sql()}")
def c1(spark, folder):
    p = projection.to_utm43n(F.col("lon"), F.col("lat"))
    projected = lonlat(spark, folder).select("id", p.alias("p"))
    return projected.select("id", rounded("p.x", 3).alias("x"), rounded("p.y", 3).alias("y"))


@query(
    "c1_from_utm43n",
    f"SELECT c_custkey AS id, {R('73.0::DOUBLE + (c_acctbal + 1000) / 11000 * 4', 8)} AS lon, {R('12.0::DOUBLE + (c_custkey * 37 % 5000) / 1000.0::DOUBLE', 8)} AS lat FROM customer",
)
def c1_back(spark, folder):
    p = projection.to_utm43n(F.col("lon"), F.col("lat"))
    there = lonlat(spark, folder).select("id", p.alias("p"))
    back = there.select("id", projection.from_utm43n(F.col("p.x"), F.col("p.y")).alias("q"))
    return back.select("id", rounded("q.lon", 8).alias("lon"), rounded("q.lat", 8).alias("lat"))


@query(
    "c2_centroid_lines",
    f"WITH {fx.CELLS_SQL}, {fx.LINES_SQL} SELECT feature_id, {R('(x0 + x1) / 2')} AS x, {R('(y0 + y1) / 2')} AS y FROM lines",
)
def c2_lines(spark, folder):
    features = fx.lines(spark, folder, fx.cell_grid(spark, folder))
    c = features.select("feature_id", geo.centroid(F.col("geom")).alias("c"))
    return c.select("feature_id", rounded("c.x").alias("x"), rounded("c.y").alias("y"))


@query(
    "c2_centroid_polygons",
    f"WITH {fx.CELLS_SQL}, {fx.BOXES_SQL} SELECT feature_id, {R('(x0 + x1) / 2')} AS x, {R('(y0 + y1) / 2')} AS y FROM boxes",
)
def c2_boxes(spark, folder):
    features = fx.boxes(spark, folder, fx.cell_grid(spark, folder))
    c = features.select("feature_id", geo.centroid(F.col("geom")).alias("c"))
    return c.select("feature_id", rounded("c.x").alias("x"), rounded("c.y").alias("y"))


@query(
    "c3_world_to_pixel",
    f"""WITH {fx.CELLS_SQL}, {fx.POINTS_SQL}
    SELECT id, CAST(floor((h * 50.0::DOUBLE - y) / 50) AS BIGINT) AS row, CAST(floor(x / 50) AS BIGINT) AS col FROM points, dim""",
)
def c3(spark, folder):
    grid = fx.cell_grid(spark, folder)
    return world_to_pixel(fx.points(spark, folder, grid), grid).select("id", "row", "col")


_BOUNDS = """SELECT c_nationkey % 5 AS layer, min(c_acctbal) AS minx, min(c_custkey * 10.0::DOUBLE) AS miny, max(c_acctbal) AS maxx, max(c_custkey * 10.0::DOUBLE) AS maxy FROM customer GROUP BY 1"""


@query(
    "c4_study_extent",
    f"""WITH bounds AS ({_BOUNDS}), e AS (SELECT max(minx) AS minx, max(miny) AS miny, min(maxx) AS maxx, min(maxy) AS maxy FROM bounds)
    SELECT 'EPSG:32643' AS crs, minx, miny, maxx, maxy, {R('(maxx - minx) * (maxy - miny) / 1e6')} AS area_km2,
           CAST(trunc((maxx - minx) / 50) AS INTEGER) AS width_px, CAST(trunc((maxy - miny) / 50) AS INTEGER) AS height_px, 50.0::DOUBLE AS resolution_m FROM e""",
)
def c4(spark, folder):
    bounds = fx.table(spark, folder, "customer").groupBy((F.col("c_nationkey") % 5).alias("layer")).agg(
        F.min("c_acctbal").alias("minx"), F.min(F.col("c_custkey") * 10.0).alias("miny"),
        F.max("c_acctbal").alias("maxx"), F.max(F.col("c_custkey") * 10.0).alias("maxy"),
    )
    return round_columns(study_extent(bounds), ["area_km2"])


_CLIP = Grid(500.0, 300.0, 4100.0, 2900.0, 72, 52)

#: Rings around a centre, in multiples of a size: an outline with a notch, its hole, and a second outline.
_RINGS = [
    [(-1.0, -1.0), (1.0, -0.8), (0.3, 0.0), (0.9, 1.0), (-0.8, 0.7)],
    [(-0.4, -0.4), (-0.4, 0.2), (0.1, 0.1), (0.1, -0.4)],
    [(1.5, -0.5), (2.5, -0.5), (2.0, 0.6)],
]
_CENTRE = [("cx", "c_custkey * 37 % 5000"), ("cy", "c_custkey * 91 % 3500"), ("size", "100 + c_custkey * 13 % 1900")]
_CORNERS = ", ".join(
    f"({r}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for r, ring in enumerate(_RINGS) for i, (x, y) in enumerate([*ring, ring[0]])
)
#: Area and moments inside the box, edge by edge: the stretch under an edge, with its height held to the box, is a
#: quadratic between the places where the edge meets a side, so that three values of each stretch give its integral.
OUTLINES_SQL = f"""shapes AS (SELECT c_custkey AS id, {", ".join(f"({e})::DOUBLE AS {n}" for n, e in _CENTRE)} FROM customer),
    corners(ring, i, ox, oy) AS (VALUES {_CORNERS}),
    placed AS (SELECT id, ring, i, cx + ox * size AS x, cy + oy * size AS y FROM shapes, corners WHERE ring < 2 OR id % 2 = 0),
    edges AS (SELECT id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM placed WINDOW w AS (PARTITION BY id, ring ORDER BY i)),
    stops AS (SELECT *, list_sort(list_transform([0.0::DOUBLE, 1.0, (500 - x0) / nullif(x1 - x0, 0), (4100 - x0) / nullif(x1 - x0, 0),
        (300 - y0) / nullif(y1 - y0, 0), (2900 - y0) / nullif(y1 - y0, 0)], lambda t: greatest(least(coalesce(t, 0.0), 1.0), 0.0))) AS ts FROM edges WHERE x1 IS NOT NULL),
    stretches AS (SELECT id, x0, y0, x1, y1, unnest(list_zip(ts[1:5], ts[2:6])) AS t FROM stops),
    ends AS (SELECT id, x0 + t[1] * (x1 - x0) AS xa, x0 + t[2] * (x1 - x0) AS xb, least(greatest(y0 + t[1] * (y1 - y0), 300), 2900) AS ya,
        least(greatest(y0 + t[2] * (y1 - y0), 300), 2900) AS yb FROM stretches WHERE t[2] > t[1]),
    sums AS (SELECT id, sum((xa - xb) * ((ya + yb) / 2 - 300)) AS area,
        sum((xa - xb) * (xa * (ya - 300) + (xa + xb) * (ya + yb - 600) + xb * (yb - 300)) / 6) AS mx,
        sum((xa - xb) * (ya * ya + (ya + yb) * (ya + yb) + yb * yb - 6 * 90000) / 12) AS my
      FROM ends WHERE (xa + xb) / 2 BETWEEN 500 AND 4100 GROUP BY id)"""


def outlines(spark, folder):
    """Polygons with a notch and a hole, every other one with a second outline."""
    base = fx.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), *[F.expr(e).cast("double").alias(n) for n, e in _CENTRE]
    )

    def ring(corners):
        return F.array(*[
            F.struct((F.col("cx") + F.lit(x) * F.col("size")).alias("x"), (F.col("cy") + F.lit(y) * F.col("size")).alias("y"))
            for x, y in [*corners, corners[0]]
        ])

    one, two = F.array(*map(ring, _RINGS[:2])), F.array(*map(ring, _RINGS))
    several = F.col("id") % 2 == 0
    kind = F.when(several, "MultiPolygon").otherwise("Polygon")
    return base.select("id", F.struct(kind.alias("type"), F.when(several, two).otherwise(one).alias("parts")).alias("geom"))


@query(
    "c5_clip_polygons",
    f"WITH {OUTLINES_SQL} SELECT id, {R('area')} AS area, {R('mx / area', 5)} AS x, {R('my / area', 5)} AS y FROM sums WHERE area > 1e-6",
)
def c5_polygons(spark, folder):
    """Area and centroid of polygons with holes and several outlines, cut to the box."""
    cut = geo.clip_features(outlines(spark, folder), _CLIP)
    sized = cut.select("id", geo.area(F.col("geom")).alias("area"), geo.centroid(F.col("geom")).alias("c"))
    return sized.select("id", rounded("area").alias("area"), rounded("c.x", 5).alias("x"), rounded("c.y", 5).alias("y"))


@query(
    "c5_clip_points",
    f"WITH {fx.CELLS_SQL}, {fx.POINTS_SQL} SELECT id FROM points WHERE x BETWEEN 500 AND 4100 AND y BETWEEN 300 AND 2900",
)
def c5_points(spark, folder):
    return geo.clip_points(fx.points(spark, folder, fx.cell_grid(spark, folder)), _CLIP).select("id")


#: Cut against the four sides one after the other instead of by one parameter interval.
CLIP_SQL = f"""{fx.CELLS_SQL}, {fx.LINES_SQL},
  a AS (SELECT feature_id, x0, y0, x1, y1 FROM lines WHERE greatest(x0, x1) >= 500 AND least(x0, x1) <= 4100),
  b AS (SELECT feature_id,
      CASE WHEN x0 < 500 THEN 500 WHEN x0 > 4100 THEN 4100 ELSE x0 END AS x0,
      CASE WHEN x0 < 500 THEN y0 + (500 - x0) / (x1 - x0) * (y1 - y0) WHEN x0 > 4100 THEN y0 + (4100 - x0) / (x1 - x0) * (y1 - y0) ELSE y0 END AS y0,
      CASE WHEN x1 < 500 THEN 500 WHEN x1 > 4100 THEN 4100 ELSE x1 END AS x1,
      CASE WHEN x1 < 500 THEN y0 + (500 - x0) / (x1 - x0) * (y1 - y0) WHEN x1 > 4100 THEN y0 + (4100 - x0) / (x1 - x0) * (y1 - y0) ELSE y1 END AS y1 FROM a),
  c AS (SELECT * FROM b WHERE greatest(y0, y1) >= 300 AND least(y0, y1) <= 2900),
  clipped AS (SELECT feature_id,
      CASE WHEN y0 < 300 THEN x0 + (300 - y0) / (y1 - y0) * (x1 - x0) WHEN y0 > 2900 THEN x0 + (2900 - y0) / (y1 - y0) * (x1 - x0) ELSE x0 END AS x0,
      CASE WHEN y0 < 300 THEN 300 WHEN y0 > 2900 THEN 2900 ELSE y0 END AS y0,
      CASE WHEN y1 < 300 THEN x0 + (300 - y0) / (y1 - y0) * (x1 - x0) WHEN y1 > 2900 THEN x0 + (2900 - y0) / (y1 - y0) * (x1 - x0) ELSE x1 END AS x1,
      CASE WHEN y1 < 300 THEN 300 WHEN y1 > 2900 THEN 2900 ELSE y1 END AS y1 FROM c)"""


@query(
    "c5_clip_lines",
    f"WITH {CLIP_SQL} SELECT feature_id, {R('x0')} AS x0, {R('y0')} AS y0, {R('x1')} AS x1, {R('y1')} AS y1 FROM clipped",
)
def c5_lines(spark, folder):
    segs = geo.segments(fx.lines(spark, folder, fx.cell_grid(spark, folder)))
    return round_columns(geo.clip_segments(segs, _CLIP).drop("kind"), ["x0", "y0", "x1", "y1"])


@query("c6_valid_geometry", "SELECT event_id AS feature_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0")
def c6(spark, folder):
    features = fx.lines(spark, folder, fx.cell_grid(spark, folder))
    geom = F.col("geom")
    nothing = F.struct(geom["type"].alias("type"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("parts"))
    spoiled = F.when(F.col("feature_id") % 3 == 0, None).when(F.col("feature_id") % 5 == 0, nothing).otherwise(geom)
    return geo.valid_geometry(features.withColumn("geom", spoiled)).select("feature_id")


# ---- rasterisation -------------------------------------------------------

#: A cell is touched when the part of the line inside its rectangle is not empty.
LINE_CELLS_SQL = f"""{fx.CELLS_SQL}, {fx.LINES_SQL},
  near AS (
    SELECT l.feature_id, l.kind, c.row, c.col, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, c.col * 50.0::DOUBLE AS xl, (c.col + 1) * 50.0::DOUBLE AS xr,
           (h - c.row - 1) * 50.0::DOUBLE AS yb, (h - c.row) * 50.0::DOUBLE AS yt
    FROM lines l, dim, cells c
    WHERE c.col BETWEEN floor(least(x0, x1) / 50) AND floor(greatest(x0, x1) / 50)
      AND c.row BETWEEN floor((h * 50.0::DOUBLE - greatest(y0, y1)) / 50) AND floor((h * 50.0::DOUBLE - least(y0, y1)) / 50)),
  touched AS (
    SELECT feature_id, kind, row, col FROM near
    WHERE greatest(0, least((xl - x0) / dx, (xr - x0) / dx), least((yb - y0) / dy, (yt - y0) / dy))
       <= least(1, greatest((xl - x0) / dx, (xr - x0) / dx), greatest((yb - y0) / dy, (yt - y0) / dy)))"""


@query("j3_burn_lines", f"WITH {LINE_CELLS_SQL} SELECT row, col, CAST(max(feature_id) AS DOUBLE) AS value FROM touched GROUP BY row, col")
def j3(spark, folder):
    grid = fx.cell_grid(spark, folder)
    features = fx.lines(spark, folder, grid).withColumn("number", F.col("feature_id").cast("double"))
    return geo.burn(features, grid, "number")


@query(
    "j3_burn_points",
    f"""WITH {fx.CELLS_SQL}, {fx.POINTS_SQL} SELECT DISTINCT c.row, c.col, 1.0::DOUBLE AS value FROM points p, dim, cells c
    WHERE c.row = CAST(floor((h * 50.0::DOUBLE - y) / 50) AS BIGINT) AND c.col = CAST(floor(x / 50) AS BIGINT)""",
)
def j3_points(spark, folder):
    grid = fx.cell_grid(spark, folder)
    features = fx.points(spark, folder, grid).select(F.col("id").alias("feature_id"), point_geometry(F.col("x"), F.col("y")).alias("geom"))
    return geo.burn(features, grid)


@query(
    "j4_burn_category",
    f"""WITH {fx.CELLS_SQL}, {fx.BOXES_SQL}, codes AS (SELECT category, row_number() OVER (ORDER BY category) AS code FROM (SELECT DISTINCT category FROM boxes))
    SELECT c.row, c.col, CAST(coalesce(max(code), 0) AS DOUBLE) AS code
    FROM dim, cells c LEFT JOIN boxes b ON b.x0 <= (c.col + 1) * 50.0::DOUBLE AND b.x1 >= c.col * 50.0::DOUBLE AND b.y0 <= ((SELECT h FROM dim) - c.row) * 50.0::DOUBLE
      AND b.y1 >= ((SELECT h FROM dim) - c.row - 1) * 50.0::DOUBLE
    LEFT JOIN codes USING (category) GROUP BY c.row, c.col""",
)
def j4(spark, folder):
    grid = fx.cell_grid(spark, folder)
    burned = geo.burn_category(fx.boxes(spark, folder, grid), grid, "category")
    return geo.on_full_grid(spark, burned, grid, fx.cells(spark, folder).select("row", "col"))


@query("a36_category_codes", "SELECT category, row_number() OVER (ORDER BY category) AS code FROM (SELECT DISTINCT 'R' || n_regionkey AS category FROM nation)")
def a36(spark, folder):
    return geo.category_codes(fx.boxes(spark, folder, fx.cell_grid(spark, folder)), "category")


def _buffer_sql(radius: int) -> str:
    return f"""WITH {fx.CELLS_SQL}, {fx.POINTS_SQL}, hit AS (
      SELECT DISTINCT c.row, c.col FROM points p, dim, cells c WHERE power(greatest(c.col * 50.0::DOUBLE - x, x - (c.col + 1) * 50.0::DOUBLE, 0), 2) + power(greatest((h - c.row - 1) * 50.0::DOUBLE - y, y - (h - c.row) * 50.0::DOUBLE, 0), 2) <= {radius * radius})
    SELECT c.row, c.col, CAST(hit.row IS NOT NULL AS BIGINT) AS label FROM cells c LEFT JOIN hit ON hit.row = c.row AND hit.col = c.col"""


@query("j5_buffer_label", _buffer_sql(100))
def j5(spark, folder):
    grid = fx.cell_grid(spark, folder)
    return geo.buffer_label(fx.cells(spark, folder), fx.points(spark, folder, grid), grid, 100.0)


@query("j5_buffer_label_500m", _buffer_sql(500))
def j5_500(spark, folder):
    """The usual buffer of 500 m around the occurrences."""
    grid = fx.cell_grid(spark, folder)
    return geo.buffer_label(fx.cells(spark, folder), fx.points(spark, folder, grid), grid, 500.0)


def _label_sql() -> str:
    return f"""WITH {fx.CELLS_SQL}, {fx.POINTS_SQL}, {fx.BOXES_SQL},
    sites AS (SELECT x, y FROM points WHERE id % 2 = 0 UNION ALL SELECT (x0 + x1) / 2, (y0 + y1) / 2 FROM boxes),
    hit AS (
      SELECT DISTINCT c.row, c.col FROM sites, dim, cells c
      WHERE power(greatest(c.col * 50.0::DOUBLE - x, x - (c.col + 1) * 50.0::DOUBLE, 0), 2) + power(greatest((h - c.row - 1) * 50.0::DOUBLE - y, y - (h - c.row) * 50.0::DOUBLE, 0), 2) <= 22500),
    labelled AS (SELECT c.row, c.col, CAST(hit.row IS NOT NULL AS BIGINT) AS label FROM cells c LEFT JOIN hit ON hit.row = c.row AND hit.col = c.col),
    {fx.FOLDS_SQL.replace("FROM cells c", "FROM labelled c")}
    SELECT fold, count(*) FILTER (WHERE region = 'test' AND label = 1) AS n_test_pos, count(*) FILTER (WHERE region = 'train' AND label = 1) AS n_train_pos,
           count(*) FILTER (WHERE region = 'train' AND label = 0) AS n_train_unl FROM fold_cells GROUP BY fold"""


@query("c10_label_plan", _label_sql())
def label_plan(spark, folder):
    """Layers to folds as one job: its tables are written, and the counts read back."""
    grid = fx.cell_grid(spark, folder)
    even = F.when(F.col("id") % 2 == 0, point_geometry(F.col("x"), F.col("y")))
    layers = {
        "mines_a": fx.points(spark, folder, grid).select(F.col("id").alias("feature_id"), even.alias("geom")),
        "quarry_boxes": fx.boxes(spark, folder, grid),
        "fault_lines": fx.lines(spark, folder, grid).select("feature_id", "geom"),
    }
    out = label_cells(layers, fx.stored_cells(spark, folder), grid, fx.strips(grid), 150.0)
    path = scratch_path(spark, "labelled")
    out.write(path)
    return spark.read.schema("fold bigint, n_test_pos bigint, n_train_pos bigint, n_train_unl bigint").json(f"{path}/counts")
