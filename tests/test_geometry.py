import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from cellweave.functions.projection import from_utm43n, project_geometry, to_utm43n
from cellweave.grid import Grid, study_extent, world_to_pixel
from cellweave.operators import geometry as geo

GEOM = "feature_id bigint, cat string, geom struct<type: string, parts: array<array<struct<x: double, y: double>>>>"


def _shape(kind, *parts):
    return (kind, [[(float(x), float(y)) for x, y in part] for part in parts])


def _features(spark, *shapes):
    return spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(shapes)], GEOM)


def test_projection_known_points_and_round_trip(spark):
    df = spark.createDataFrame([(75.0, 0.0), (75.0, 45.0), (78.0, 15.5)], "lon double, lat double")
    p = df.select("lon", "lat", to_utm43n(F.col("lon"), F.col("lat")).alias("p"))
    rows = p.select("lon", "lat", "p.*", from_utm43n(F.col("p.x"), F.col("p.y")).alias("q")).collect()
    assert (rows[0]["x"], rows[0]["y"]) == (500000.0, 0.0)
    assert abs(rows[1]["y"] - 0.9996 * 4984944.378) < 0.01  # meridian arc to 45 degrees
    assert all(abs(r["q"]["lon"] - r["lon"]) < 1e-10 and abs(r["q"]["lat"] - r["lat"]) < 1e-10 for r in rows)


def test_centroids(spark):
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(2, 1), (2, 3), (3, 3), (3, 1), (2, 1)]
    df = _features(
        spark,
        ("a", _shape("Point", [(3, 4)])),
        ("a", _shape("LineString", [(0, 0), (3, 0), (3, 1)])),
        ("a", _shape("Polygon", square)),
        ("a", _shape("Polygon", square, hole)),
        ("a", _shape("MultiPoint", [(0, 0)], [(2, 6)])),
        ("a", _shape("LineString", [(5, 5), (5, 5)])),
    )
    got = [(r["x"], r["y"]) for r in df.orderBy("feature_id").select(geo.centroid(F.col("geom")).alias("c")).select("c.*").collect()]
    assert got[0] == (3, 4) and got[2] == (2, 2) and got[4] == (1, 3) and got[5] == (5, 5)
    assert math.isclose(got[1][0], (3 * 1.5 + 1 * 3) / 4) and math.isclose(got[1][1], 0.5 / 4)
    assert math.isclose(got[3][0], (16 * 2 - 2 * 2.5) / 14) and math.isclose(got[3][1], 2)


def test_invalid_geometry_is_dropped(spark):
    df = _features(spark, ("a", None), ("a", ("Point", [])), ("a", ("LineString", [[]])), ("a", _shape("Point", [(1, 1)])))
    assert [r["feature_id"] for r in geo.valid_geometry(df).collect()] == [3]


def test_polygon_burn_equals_brute_force(spark):
    grid = Grid.of_shape(12, 12, 10.0)
    ring = [(13, 21), (97, 14), (88, 93), (51, 38), (22, 87), (13, 21)]  # concave
    got = {(r["row"], r["col"]) for r in geo.burn(_features(spark, ("a", _shape("Polygon", ring))), grid).collect()}

    def inside(x, y):
        odd = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0):
                odd = not odd
        return odd

    def crosses(r, c):
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            for i in range(4001):
                x, y = x0 + (x1 - x0) * i / 4000, y0 + (y1 - y0) * i / 4000
                if math.floor(x / 10) == c and math.floor((120 - y) / 10) == r:
                    return True
        return False

    expected = {(r, c) for r in range(12) for c in range(12) if inside(10 * c + 5, 120 - 10 * r - 5) or crosses(r, c)}
    assert got == expected


def test_later_feature_and_higher_code_win(spark):
    grid = Grid.of_shape(4, 4, 1.0)
    a, b = [(0.1, 0.1), (2.9, 0.1), (2.9, 2.9), (0.1, 2.9), (0.1, 0.1)], [(1.1, 1.1), (3.9, 1.1), (3.9, 3.9), (1.1, 3.9), (1.1, 1.1)]
    df = _features(spark, ("z", _shape("Polygon", a)), ("m", _shape("Polygon", b)), ("z", _shape("Polygon", a)), (None, _shape("Point", [(3.5, 0.5)])))
    burned = {(r["row"], r["col"]): r["value"] for r in geo.burn(df.withColumn("n", F.col("feature_id") * 10), grid, "n").collect()}
    assert burned[(1, 2)] == 20 and burned[(0, 3)] == 10 and burned[(3, 3)] == 30
    codes = {(r["row"], r["col"]): r["code"] for r in geo.burn_category(df, grid, "cat").collect()}
    assert codes[(1, 2)] == 2.0 and codes[(0, 3)] == 1.0 and (3, 3) not in codes
    assert codes[(3, 0)] == 2.0  # equal overlapping polygons do not cancel out
    full = geo.on_full_grid(spark, geo.burn_category(df, grid, "cat"), grid)
    assert full.count() == 16 and full.where("code = 0").count() == 16 - len(codes)


def test_segments_are_cut_at_the_box(spark):
    df = _features(spark, ("a", _shape("LineString", [(-5, 5), (15, 5), (15, 30)])), ("a", _shape("LineString", [(-5, -5), (-1, 20)])))
    got = geo.clip_segments(geo.segments(df), Grid(0.0, 0.0, 10.0, 10.0, 10, 10)).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in got] == [(0, 5, 10, 5)]


def test_geometries_are_cut_at_the_box(spark):
    grid = Grid(0.0, 0.0, 10.0, 10.0, 10, 10)
    square, hole = [(-4, 2), (4, 2), (4, 8), (-4, 8), (-4, 2)], [(-2, 3), (-2, 5), (2, 5), (2, 3), (-2, 3)]
    around = [(-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5)]
    comb = [(12, 1), (12, 9), (5, 9), (5, 7), (11, 7), (11, 3), (5, 3), (5, 1), (12, 1)]
    df = _features(
        spark,
        ("a", _shape("MultiPoint", [(0, 0)], [(11, 1)], [(10, 10)])),
        ("a", _shape("LineString", [(2, 2), (2, 12), (4, 12), (4, 4), (6, 4)])),
        ("a", _shape("Polygon", square, hole)),
        ("a", _shape("MultiPolygon", around, [(20, 20), (30, 20), (30, 30), (20, 20)])),
        ("a", _shape("Polygon", comb)),
        ("a", _shape("Polygon", around, around[::-1])),
        ("a", _shape("Polygon", [(10, 0), (14, 0), (14, 5), (10, 0)])),
        ("a", _shape("LineString", [(-1, -1), (-1, 11)])),
        ("a", ("Polygon", [])),
        ("a", ("LineString", [[]])),
        ("a", None),
    )
    g = F.col("geom")
    got = {r["feature_id"]: r for r in geo.clip_features(df, grid).select("*", geo.area(g).alias("area"), geo.centroid(g).alias("c")).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    points = {i: [[(p["x"], p["y"]) for p in part] for part in r["geom"]["parts"]] for i, r in got.items()}
    assert points[0] == [[(0, 0)], [(10, 10)]]
    assert points[1] == [[(2, 2), (2, 10)], [(4, 10), (4, 4), (6, 4)]]
    assert got[2]["area"] == 4 * 6 - 2 * 2 and math.isclose(got[2]["c"]["y"], (24 * 5 - 4 * 4) / 20)
    assert abs(got[3]["area"]) == 100 and len(points[3]) == 1
    assert abs(got[4]["area"]) == 2 * 5 * 2
    assert [r["geom"]["type"] for _, r in sorted(got.items())][2:4] == ["Polygon", "MultiPolygon"]
    assert geo.clip_features(df.limit(0), grid).count() == 0


def test_buffer_is_exact_at_the_radius(spark):
    grid = Grid.of_shape(30, 30)
    cells = spark.range(900).select(F.expr("id div 30").alias("row"), (F.col("id") % 30).alias("col"))
    points = spark.createDataFrame([Row(x=750.0, y=750.0)])
    got = geo.buffer_label(cells, points, grid).where("label = 1").collect()
    expected = 0
    for r in range(30):
        for c in range(30):
            dx = max(c * 50 - 750, 750 - (c + 1) * 50, 0)
            dy = max(1500 - (r + 1) * 50 - 750, 750 - (1500 - r * 50), 0)
            expected += dx * dx + dy * dy <= 500 * 500
    assert len(got) == expected


def test_extent_pixels_and_vertices(spark):
    b = spark.createDataFrame([(0.0, 0.0, 1000.0, 1030.0), (10.0, -5.0, 990.0, 2000.0)], "minx double, miny double, maxx double, maxy double")
    row = study_extent(b).first()
    assert (row["minx"], row["maxy"], row["width_px"], row["height_px"]) == (10.0, 1030.0, 19, 20)
    grid = Grid.of_extent(row)
    p = world_to_pixel(spark.createDataFrame([(10.0, 1030.0), (989.9, 0.1)], "x double, y double"), grid).collect()
    assert [(r["row"], r["col"]) for r in p] == [(0, 0), (19, 18)]
    line = _features(spark, ("a", _shape("LineString", [(75, 0), (75, 0)]))).select(project_geometry(F.col("geom")).alias("g"))
    assert line.first()["g"]["parts"][0][0]["x"] == 500000.0


def test_polygons_of_one_part_are_cut_by_all_cores(spark):
    ring = "array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 9.0D, 'y', 0.0D), named_struct('x', 9.0D, 'y', 9.0D), named_struct('x', 0.0D, 'y', 0.0D))"
    shapes = spark.range(20).coalesce(1).selectExpr("id", f"named_struct('type', 'Polygon', 'parts', array({ring})) AS geom")
    cut = geo.clip_features(shapes, Grid(0.0, 0.0, 4.0, 4.0, 4, 4))
    assert cut.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert cut.columns == ["id", "geom"] and cut.select(geo.area(F.col("geom")).alias("a")).distinct().first()["a"] == 8.0


def test_many_points_are_not_gathered_for_their_buffer_or_window(spark):
    from cellweave.operators.points import point_window_median

    grid = Grid(0.0, 0.0, 100.0, 100.0, 10, 10)
    points = spark.range(60_000).selectExpr("id", "id % 100 + 0.5D AS x", "id * 7 % 100 + 0.5D AS y")
    cells = spark.range(100).selectExpr("id div 10 AS row", "id % 10 AS col", "id * 1.0D AS v")
    for made in (point_window_median(points, cells, ["v"], grid), geo.buffer_label(cells.crossJoin(spark.range(1)), points, grid, 500.0)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
