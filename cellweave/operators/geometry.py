"""Vector layers: centroids, clipping, rasterisation and buffers.

A geometry is `STRUCT<type STRING, parts ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>`.
Polygon rings are parts; holes wind against their outer ring, as the common vector
formats prescribe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.grid import Grid
from cellweave.operators.spans import disc_spans, merged_spans, unrolled
from cellweave.scale import broadcast_if_small, running_totals, small_side, spread


def valid_geometry(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Drop features whose geometry is missing or has no vertex."""
    vertices = F.aggregate(F.col(geom)["parts"], F.lit(0), lambda n, part: n + F.size(part))
    return df.where(F.col(geom).isNotNull() & (F.coalesce(vertices, F.lit(0)) > 0))


def bounding_box(geom: Column) -> Column:
    """STRUCT<minx,miny,maxx,maxy> of one geometry."""
    points = F.flatten(geom["parts"])
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")
    )


def _edges(geom: Column) -> Column:
    """ARRAY of STRUCT<a,b>: consecutive vertices of every part."""
    def pairs(part: Column) -> Column:
        ahead = F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0)))
        behind = F.slice(part, F.lit(1), F.greatest(F.size(part) - 1, F.lit(0)))
        return F.zip_with(behind, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return F.flatten(F.transform(geom["parts"], pairs))


def centroid(geom: Column) -> Column:
    """STRUCT<x,y>: area centroid of polygons, length centroid of lines, mean of points."""
    points = F.flatten(geom["parts"])
    origin = F.get(points, F.lit(0))
    edges = _edges(geom)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def gather(items: Column, weight, px, py) -> Column:
        return F.aggregate(
            items,
            zero,
            lambda s, e: F.struct(
                (s["w"] + weight(e)).alias("w"),
                (s["x"] + weight(e) * px(e)).alias("x"),
                (s["y"] + weight(e) * py(e)).alias("y"),
            ),
            lambda s: F.when(
                s["w"] != 0,
                F.struct((origin["x"] + s["x"] / s["w"]).alias("x"), (origin["y"] + s["y"] / s["w"]).alias("y")),
            ),
        )

    def dx(p: Column) -> Column:
        return p["x"] - origin["x"]

    def dy(p: Column) -> Column:
        return p["y"] - origin["y"]

    of_points = gather(points, lambda e: F.lit(1.0), dx, dy)
    of_lines = gather(
        edges,
        lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]),
        lambda e: (dx(e["a"]) + dx(e["b"])) / 2,
        lambda e: (dy(e["a"]) + dy(e["b"])) / 2,
    )
    of_areas = gather(
        edges,
        lambda e: dx(e["a"]) * dy(e["b"]) - dx(e["b"]) * dy(e["a"]),
        lambda e: (dx(e["a"]) + dx(e["b"])) / 3,
        lambda e: (dy(e["a"]) + dy(e["b"])) / 3,
    )
    return (
        F.when(geom["type"].endswith("Polygon"), F.coalesce(of_areas, of_lines, of_points))
        .when(geom["type"].endswith("LineString"), F.coalesce(of_lines, of_points))
        .otherwise(of_points)
    )


def area(geom: Column) -> Column:
    """Signed area of the rings: holes, which wind the other way, are taken off. Zero for lines and points."""
    origin = F.get(F.flatten(geom["parts"]), F.lit(0))

    def cross(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"] - origin["x"], e["a"]["y"] - origin["y"], e["b"]["x"] - origin["x"], e["b"]["y"] - origin["y"]
        return (ax * by - bx * ay) / 2

    total = F.aggregate(_edges(geom), F.lit(0.0), lambda s, e: s + cross(e))
    return F.when(geom["type"].endswith("Polygon"), F.coalesce(total, F.lit(0.0))).otherwise(0.0)


def _vertex(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _cut_ring(ring: Column, grid: Grid) -> Column:
    """A closed ring cut at the four sides of the box one after the other; empty when nothing is left."""
    sides = F.array(*[
        F.struct(F.lit(axis).alias("axis"), F.lit(sign).alias("sign"), F.lit(float(bound)).alias("bound"))
        for axis, sign, bound in (("x", 1.0, grid.minx), ("x", -1.0, grid.maxx), ("y", 1.0, grid.miny), ("y", -1.0, grid.maxy))
    ])

    def cut(corners: Column, side: Column) -> Column:
        on_x = side["axis"] == "x"

        def depth(p: Column) -> Column:
            return side["sign"] * (F.when(on_x, p["x"]).otherwise(p["y"]) - side["bound"])

        def kept(a: Column, b: Column) -> Column:
            t = depth(a) / (depth(a) - depth(b))
            meet = _vertex(
                F.when(on_x, side["bound"]).otherwise(a["x"] + t * (b["x"] - a["x"])),
                F.when(on_x, a["y"] + t * (b["y"] - a["y"])).otherwise(side["bound"]),
            )
            enters, leaves = (depth(a) < 0) & (depth(b) > 0), (depth(a) > 0) & (depth(b) < 0)
            crossing = F.when(enters | leaves, F.array(meet)).otherwise(F.slice(F.array(a), 1, 0))
            return F.concat(crossing, F.when(depth(b) >= 0, F.array(b)).otherwise(F.slice(F.array(b), 1, 0)))

        size = F.greatest(F.size(corners) - 1, F.lit(0))
        left = F.flatten(F.zip_with(F.slice(corners, F.lit(1), size), F.slice(corners, F.lit(2), size), kept))
        return F.concat(left, F.slice(left, 1, 1))

    return F.aggregate(sides, ring, cut)


def _cut_line(line: Column, grid: Grid) -> Column:
    """The pieces of a line inside the box: every edge cut by its parameters, edges that meet strung together."""
    size = F.greatest(F.size(line) - 1, F.lit(0))

    def inside(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        sides = [(-dx, a["x"] - grid.minx), (dx, grid.maxx - a["x"]), (-dy, a["y"] - grid.miny), (dy, grid.maxy - a["y"])]
        enter = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p).otherwise(0.0) for p, q in sides])
        leave = F.least(F.lit(1.0), *[F.when(p > 0, q / p).otherwise(1.0) for p, q in sides])
        missed = (sides[0][0] == 0) & ((sides[0][1] < 0) | (sides[1][1] < 0)) | (sides[2][0] == 0) & ((sides[2][1] < 0) | (sides[3][1] < 0))
        start = F.when(enter > 0, _vertex(a["x"] + enter * dx, a["y"] + enter * dy)).otherwise(_vertex(a["x"], a["y"]))
        stop = F.when(leave < 1, _vertex(a["x"] + leave * dx, a["y"] + leave * dy)).otherwise(_vertex(b["x"], b["y"]))
        return F.struct(F.when(~missed & (enter < leave), F.array(start, stop)).alias("piece"))

    cuts = F.zip_with(F.slice(line, F.lit(1), size), F.slice(line, F.lit(2), size), inside)
    pieces = F.transform(F.filter(cuts, lambda c: c["piece"].isNotNull()), lambda c: c["piece"])
    # Where a piece starts anew, the pieces up to the next such place make one line.
    starts = F.filter(
        F.transform(pieces, lambda p, i: F.when((i == 0) | (F.get(F.get(pieces, i - 1), F.lit(1)) != F.get(p, F.lit(0))), i)),
        lambda i: i.isNotNull(),
    )

    def strung(at: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), F.size(pieces))
        run = F.slice(pieces, at + 1, stop - at)
        return F.concat(F.slice(F.get(run, F.lit(0)), 1, 1), F.transform(run, lambda p: F.get(p, F.lit(1))))

    return F.transform(starts, strung)


def clip_geometry(geom: Column, grid: Grid) -> Column:
    """The part of a geometry inside the box of `grid`, of the same type; null when nothing is left.

    Points on the border stay. Lines become as many parts as they have stretches of some length inside. Rings
    keep their winding, so holes stay holes; rings without area inside go, and a hole that covers the box leaves a
    polygon without area, which goes as well. A concave ring that leaves the box and comes back stays one ring whose
    stretches are joined along the border: area, centroid and even-odd filling are those of the intersection.
    Vertices without coordinates count as absent.
    """
    parts = F.transform(geom["parts"], lambda part: F.filter(part, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    box = lambda p: p["x"].between(grid.minx, grid.maxx) & p["y"].between(grid.miny, grid.maxy)

    def has_area(ring: Column) -> Column:
        return area(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("parts"))) != 0

    as_points = F.transform(parts, lambda part: F.filter(part, box))
    as_lines = F.flatten(F.transform(parts, lambda part: _cut_line(part, grid)))
    as_rings = F.filter(F.transform(parts, lambda part: _cut_ring(part, grid)), has_area)
    cut = (
        F.when(geom["type"].endswith("Polygon"), as_rings).when(geom["type"].endswith("LineString"), as_lines).otherwise(as_points)
    )
    whole = F.struct(geom["type"].alias("type"), F.filter(cut, lambda part: F.size(part) > 0).alias("parts"))
    # A one-element array binds the result, so that nothing is cut twice.
    bound = F.transform(F.array(whole), lambda g: F.when(
        (F.size(g["parts"]) > 0) & (~g["type"].endswith("Polygon") | (F.abs(area(g)) > 0)), g
    ))
    return F.get(bound, F.lit(0))


def clip_features(features: DataFrame, grid: Grid, geom: str = "geom") -> DataFrame:
    """Features cut to the box of `grid`; those without a part inside go, and so do missing geometries."""
    rest = [F.col(c) for c in features.columns]
    # The generator binds the cut geometry; a filter on it would be pushed down together with a second copy of the work.
    cut = F.explode(F.array(F.struct(clip_geometry(F.col(geom), grid).alias("cut")))).alias("_cut")
    clipped = spread(features).select(*rest, cut).where(F.col("_cut.cut").isNotNull())
    return clipped.withColumn(geom, F.col("_cut.cut")).drop("_cut")


def clip_points(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    return points.where(grid.has_xy(F.col(x), F.col(y)))


def segments(features: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per edge: the feature's other columns plus x0,y0,x1,y1."""
    rest = [c for c in features.columns if c != geom]
    edge = F.explode(_edges(F.col(geom))).alias("_e")
    return features.select(*rest, edge).select(
        *rest,
        F.col("_e.a.x").alias("x0"), F.col("_e.a.y").alias("y0"), F.col("_e.b.x").alias("x1"), F.col("_e.b.y").alias("y1"),
    )


def clip_segments(segs: DataFrame, grid: Grid) -> DataFrame:
    """Cut every segment to the grid box (parametric clipping); drop those outside."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sides = [
        (-dx, F.col("x0") - grid.minx),
        (dx, grid.maxx - F.col("x0")),
        (-dy, F.col("y0") - grid.miny),
        (dy, grid.maxy - F.col("y0")),
    ]
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p).otherwise(0.0) for p, q in sides])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, q / p).otherwise(1.0) for p, q in sides])
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))
    rest = [c for c in segs.columns if c not in ("x0", "y0", "x1", "y1")]
    return (
        segs.withColumn("_t0", enter)
        .withColumn("_t1", leave)
        .where(~outside & (F.col("_t0") <= F.col("_t1")))
        .select(
            *rest,
            (F.col("x0") + F.col("_t0") * dx).alias("x0"),
            (F.col("y0") + F.col("_t0") * dy).alias("y0"),
            (F.col("x0") + F.col("_t1") * dx).alias("x1"),
            (F.col("y0") + F.col("_t1") * dy).alias("y1"),
        )
    )


def _span(low: Column, high: Column, size: int) -> tuple[Column, Column]:
    """Clamp an index interval to 0..size-1; empty when low > high."""
    return F.greatest(low, F.lit(0)), F.least(high, F.lit(size - 1))


def spans_on_segments(segs: DataFrame, grid: Grid) -> DataFrame:
    """The cells that a segment touches: `row, lo, hi` next to the other columns, one span for each row it crosses."""
    rest = [c for c in segs.columns if c not in ("x0", "y0", "x1", "y1")]
    ends = segs.select(
        *rest,
        grid.u(F.col("x0")).alias("_u0"), grid.v(F.col("y0")).alias("_v0"),
        grid.u(F.col("x1")).alias("_u1"), grid.v(F.col("y1")).alias("_v1"),
    )
    low, high = _span(
        F.floor(F.least("_v0", "_v1")).cast("bigint"), F.floor(F.greatest("_v0", "_v1")).cast("bigint"), grid.height
    )
    rows = (
        ends.withColumn("_lo", low).withColumn("_hi", high).where(F.col("_lo") <= F.col("_hi"))
        .withColumn("row", F.explode(F.sequence("_lo", "_hi")))
    )
    dv = F.col("_v1") - F.col("_v0")

    def at(v: Column, default: float) -> Column:
        return F.when(dv != 0, F.least(F.greatest((v - F.col("_v0")) / dv, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(default))

    def u_at(t: Column) -> Column:
        return F.when(t >= 1.0, F.col("_u1")).otherwise(F.col("_u0") + t * (F.col("_u1") - F.col("_u0")))

    rows = rows.withColumn("_ua", u_at(at(F.col("row"), 0.0))).withColumn("_ub", u_at(at(F.col("row") + 1, 1.0)))
    low, high = _span(
        F.floor(F.least("_ua", "_ub")).cast("bigint"), F.floor(F.greatest("_ua", "_ub")).cast("bigint"), grid.width
    )
    return rows.select(*rest, "row", low.alias("lo"), high.alias("hi")).where(F.col("lo") <= F.col("hi"))


def spans_in_polygons(segs: DataFrame, grid: Grid, feature: str) -> DataFrame:
    """Cells whose centre lies inside a polygon (even-odd rule): `feature, row, lo, hi`.

    Scanline fill: edges are unrolled into the row centres they cross, the crossings of a
    (feature, row) are ordered, and every odd crossing opens a span to the next one.
    """
    ends = segs.select(
        feature,
        grid.u(F.col("x0")).alias("_u0"), grid.v(F.col("y0")).alias("_v0"),
        grid.u(F.col("x1")).alias("_u1"), grid.v(F.col("y1")).alias("_v1"),
    )
    low, high = _span(
        F.ceil(F.least("_v0", "_v1") - 0.5).cast("bigint"), F.ceil(F.greatest("_v0", "_v1") - 0.5).cast("bigint") - 1, grid.height
    )
    crossing = F.col("_u0") + (F.col("row") + 0.5 - F.col("_v0")) / (F.col("_v1") - F.col("_v0")) * (F.col("_u1") - F.col("_u0"))
    crossings = (
        ends.withColumn("_lo", low).withColumn("_hi", high).where(F.col("_lo") <= F.col("_hi"))
        .withColumn("row", F.explode(F.sequence("_lo", "_hi")))
        .select(feature, "row", crossing.alias("_u"))
    )
    along = Window.partitionBy(feature, "row").orderBy("_u")
    spans = crossings.select(
        feature, "row", "_u", F.lead("_u").over(along).alias("_end"), F.row_number().over(along).alias("_k")
    ).where((F.col("_k") % 2 == 1) & F.col("_end").isNotNull())
    low, high = _span(F.ceil(F.col("_u") - 0.5).cast("bigint"), F.ceil(F.col("_end") - 0.5).cast("bigint") - 1, grid.width)
    return spans.select(feature, "row", low.alias("lo"), high.alias("hi")).where(F.col("lo") <= F.col("hi"))


def touched_spans(features: DataFrame, grid: Grid, feature: str = "feature_id", geom: str = "geom") -> DataFrame:
    """`feature, row, lo, hi`: spans of the cells touched by each feature (they may overlap)."""
    shaped = valid_geometry(features, geom).select(feature, geom)
    kind = F.col(geom)["type"]
    vertices = shaped.where(~kind.endswith("LineString") & ~kind.endswith("Polygon")).select(
        feature, F.explode(F.flatten(F.col(geom)["parts"])).alias("_p")
    )
    col = grid.col_of(F.col("_p.x"))
    dots = (
        vertices.select(feature, grid.row_of(F.col("_p.y")).alias("row"), col.alias("lo"), col.alias("hi"))
        .where(grid.has(F.col("row"), F.col("lo")))
    )
    edges = segments(shaped, geom)
    outline = spans_on_segments(edges, grid)
    areas = segments(shaped.where(kind.endswith("Polygon")), geom)
    return dots.unionByName(outline).unionByName(spans_in_polygons(areas, grid, feature))


def burn(
    features: DataFrame, grid: Grid, value: str | None = None, feature: str = "feature_id", geom: str = "geom"
) -> DataFrame:
    """Rasterise: `row, col, value`, the feature with the highest id winning a cell.

    Without a value the spans of all features are merged; with one, those of each feature are, and the
    winner of a cell is a map-side-combined aggregate, so piled-up features do not pile up in a task.
    """
    if value is None:
        covered = unrolled(merged_spans(touched_spans(features, grid, feature, geom).select("row", "lo", "hi")))
        return covered.select("row", "col", F.lit(1.0).alias("value"))
    carried = features.withColumn("_feature", F.struct(F.col(feature).alias("id"), F.col(value).cast("double").alias("value")))
    cells = unrolled(merged_spans(touched_spans(carried, grid, "_feature", geom), ["_feature"]))
    return cells.groupBy("row", "col").agg(F.max_by(F.col("_feature.value"), F.col("_feature.id")).alias("value"))


def category_codes(features: DataFrame, column: str) -> DataFrame:
    """`category, code`: 1-based codes of the sorted distinct non-null categories."""
    distinct = features.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.lit(1).alias("one"))
    coded = running_totals(distinct, "category", ["one"])
    return coded.select("category", F.col("cum_one").cast("bigint").alias("code"))


def burn_category(
    features: DataFrame, grid: Grid, column: str | None, feature: str = "feature_id", geom: str = "geom"
) -> DataFrame:
    """Rasterise category codes; the higher code wins. Without a column, a plain burn."""
    if column is None:
        return burn(features, grid, None, feature, geom).withColumnRenamed("value", "code")
    codes = small_side(category_codes(features, column))
    # The feature stays part of the key: overlapping polygons of one category are not one polygon.
    keyed = features.join(codes, features[column] == codes["category"]).select(
        F.struct(F.col("code"), F.col(feature).alias("id")).alias("_feature"), F.col(geom)
    )
    spans = touched_spans(keyed, grid, "_feature", geom).select(F.col("_feature.code").alias("code"), "row", "lo", "hi")
    cells = unrolled(merged_spans(spans, ["code"]))  # of one category, overlapping features count once
    return cells.groupBy("row", "col").agg(F.max("code").cast("double").alias("code"))


def on_full_grid(spark, burned: DataFrame, grid: Grid, cells: DataFrame | None = None, fill: float = 0.0) -> DataFrame:
    """Left-join a sparse burn onto all cells, filling the untouched ones."""
    from cellweave.grid import grid_cells

    frame = cells if cells is not None else grid_cells(spark, grid)
    names = [c for c in burned.columns if c not in ("row", "col")]
    joined = frame.join(burned, ["row", "col"], "left")
    return joined.select(*frame.columns, *[F.coalesce(F.col(n), F.lit(fill)).alias(n) for n in names])


def buffered_cells(points: DataFrame, grid: Grid, radius: float = 500.0, x: str = "x", y: str = "y") -> DataFrame:
    """Distinct cells touched by the disc of `radius` around any point: `row, col`.

    Each point becomes one span a row; merged spans are unrolled once, which needs no distinct over cells.
    """
    return unrolled(merged_spans(disc_spans(points, grid, radius, x, y))).select("row", "col")


def buffer_label(cells: DataFrame, points: DataFrame, grid: Grid, radius: float = 500.0) -> DataFrame:
    """`row, col, label`: 1 where the disc of any occurrence touches the cell, else 0."""
    around = 2 * math.floor(radius / grid.yres) + 3
    # The merged spans of a row stay one row, of at most half as many spans as the grid has columns.
    spans = merged_spans(disc_spans(spread(points), grid, radius))
    of_rows = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    # Few points leave the cells where they are; many are joined by row.
    joined = cells.select("row", "col").join(broadcast_if_small(of_rows, points, around), "row", "left")
    hit = F.exists("_spans", lambda s: F.col("col").between(s["lo"], s["hi"]))
    return joined.select("row", "col", F.coalesce(hit.cast("bigint"), F.lit(0)).cast("bigint").alias("label"))
