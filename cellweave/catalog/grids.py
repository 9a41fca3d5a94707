"""Queries: distances, densities, resampling and spectral products."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellweave.catalog import fixtures as fx
from cellweave.catalog.registry import R, query, round_columns, rounded
from cellweave.functions.categories import CHANNELS
from cellweave.functions.scalars import within
from cellweave.grid import Grid
from cellweave.operators import neighbourhood as nb
from cellweave.operators import spectral
from cellweave.plans import stack
from cellweave.session import scratch_path, stored

# ---- distances -----------------------------------------------------------

#: Brute force: every cell against every burned cell.
DISTANCE_SQL = (
    fx.CELLS_SQL
    + """,
fault_distance AS (
  SELECT c.row, c.col, sqrt(CAST(min((c.row - f.row) * (c.row - f.row) + (c.col - f.col) * (c.col - f.col)) AS DOUBLE)) * 50 AS d
  FROM cells c, (SELECT row, col FROM cells WHERE fault) f GROUP BY c.row, c.col),
shear_distance AS (
  SELECT c.row, c.col, sqrt(CAST(min((c.row - f.row) * (c.row - f.row) + (c.col - f.col) * (c.col - f.col)) AS DOUBLE)) * 50 AS d
  FROM cells c, (SELECT row, col FROM cells WHERE b5 > 9700) f GROUP BY c.row, c.col),
layers AS (
  SELECT f.row, f.col, f.d AS fault_distance, s.d AS shear_distance
  FROM fault_distance f JOIN shear_distance s ON f.row = s.row AND f.col = s.col)"""
)


def distance_layers(spark, folder, grid):
    """Distance to the fault cells and to a second burned layer."""
    base = fx.stored_cells(spark, folder).select("row", "col", "fault", "b5")
    fault = nb.distance_transform(base, F.col("fault"), grid, "fault_distance")
    shear = nb.distance_transform(base, F.col("b5") > 9700, grid, "shear_distance")
    return fault.join(shear, ["row", "col"])


@query("w1_distance_transform", f"WITH {DISTANCE_SQL} SELECT row, col, {R('d')} AS distance FROM fault_distance")
def w1(spark, folder):
    grid = fx.cell_grid(spark, folder)
    base = fx.cells(spark, folder).select("row", "col", "fault")
    return round_columns(nb.distance_transform(base, F.col("fault"), grid), ["distance"])


@query(
    "c7_threshold_mask",
    f"WITH {DISTANCE_SQL} SELECT row, col, d <= 50 AS near_50, d <= 150 AS near_150, d <= 200 AS near_200 FROM fault_distance",
)
def c7(spark, folder):
    grid = fx.cell_grid(spark, folder)
    d = nb.distance_transform(fx.cells(spark, folder).select("row", "col", "fault"), F.col("fault"), grid)
    return d.select("row", "col", *[within(F.col("distance"), t).alias(f"near_{t}") for t in (50, 150, 200)])


@query(
    "j7_nearest_feature_distance",
    f"""WITH {DISTANCE_SQL}, hit AS (SELECT row, col FROM layers WHERE fault_distance <= 150 AND shear_distance <= 150)
    SELECT l.row, l.col, {R('coalesce((SELECT sqrt(CAST(min((l.row - h.row) * (l.row - h.row) + (l.col - h.col) * (l.col - h.col)) AS DOUBLE)) * 50 FROM hit h), 0)')} AS distance
    FROM layers l""",
)
def j7(spark, folder):
    grid = fx.cell_grid(spark, folder)
    layers = distance_layers(spark, folder, grid)
    return round_columns(nb.nearest_feature_distance(layers, "fault_distance", "shear_distance", grid), ["distance"])


@query(
    "w2b_intersection_count",
    f"WITH {DISTANCE_SQL} SELECT row, col, CAST((fault_distance <= 200)::INT + (shear_distance <= 200)::INT AS DOUBLE) AS n FROM layers",
)
def w2b(spark, folder):
    layers = distance_layers(spark, folder, fx.cell_grid(spark, folder))
    return layers.select("row", "col", nb.intersection_count(["fault_distance", "shear_distance"]).alias("n"))


# ---- filters -------------------------------------------------------------


def _mirror(index: str, size: str) -> str:
    period = f"((({index}) % (2 * {size}) + 2 * {size}) % (2 * {size}))"
    return f"CASE WHEN {period} < {size} THEN {period} ELSE 2 * {size} - 1 - {period} END"


def filter_sql(source: str, value: str, weights: str, out: str) -> str:
    """CTEs of a separable filter with reflected boundary; `weights` is a relation (k, w)."""
    # Weights that reflection leads to the same line are added first, so each line meets another once.
    return f"""
{out}_down AS (
  SELECT row, line, sum(w) AS w FROM (SELECT r.row, w.w, {_mirror('r.row + w.k', 'dim.h')} AS line FROM (SELECT DISTINCT row FROM {source}) r, dim, {weights} w) t GROUP BY row, line),
{out}_across AS (
  SELECT col, line, sum(w) AS w FROM (SELECT c.col, w.w, {_mirror('c.col + w.k', 'dim.w')} AS line FROM (SELECT DISTINCT col FROM {source}) c, dim, {weights} w) t GROUP BY col, line),
{out}_v AS (
  SELECT d.row, s.col, sum(d.w * coalesce(s.{value}, 0)) AS x FROM {source} s JOIN {out}_down d ON d.line = s.row GROUP BY d.row, s.col),
{out} AS (
  SELECT s.row, a.col, sum(a.w * s.x) AS x FROM {out}_v s JOIN {out}_across a ON a.line = s.col GROUP BY s.row, a.col)"""


def gauss_sql(name: str, sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    return f"""{name}_raw AS (SELECT k, exp(-0.5 * (k / {sigma}::DOUBLE) * (k / {sigma}::DOUBLE)) AS w FROM (SELECT unnest(range(-{r}, {r + 1})) AS k)),
{name} AS (SELECT k, w / (SELECT sum(w) FROM {name}_raw) AS w FROM {name}_raw)"""


def scaled_sql(relation: str, name: str) -> str:
    top = f"(SELECT max(x) FROM {relation})"
    return f"SELECT row, col, {R(f'CASE WHEN {top} > 0 THEN x / {top} ELSE x END')} AS {name} FROM {relation}"


@query(
    "w2_gaussian_density",
    f"""WITH {DISTANCE_SQL}, near AS (SELECT row, col, CASE WHEN d <= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM fault_distance),
    {gauss_sql('g', 40.0)}, {filter_sql('near', 'v', 'g', 'smooth')} {scaled_sql('smooth', 'density')}""",
)
def w2(spark, folder):
    grid = fx.cell_grid(spark, folder)
    d = nb.distance_transform(fx.cells(spark, folder).select("row", "col", "fault"), F.col("fault"), grid)
    return round_columns(nb.fault_density(d, ["distance"], grid).withColumnRenamed("distance", "density"), ["density"])


@query(
    "w2a_binary_near",
    f"WITH {DISTANCE_SQL} SELECT row, col, CASE WHEN d <= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near FROM fault_distance",
)
def w2a(spark, folder):
    grid = fx.cell_grid(spark, folder)
    d = nb.distance_transform(fx.cells(spark, folder).select("row", "col", "fault"), F.col("fault"), grid)
    return d.select("row", "col", nb.binary_near(F.col("distance"), 50.0).alias("near"))


@query(
    "w2_intersection_density",
    f"""WITH {DISTANCE_SQL}, n AS (SELECT row, col, (fault_distance <= 200)::INT + (shear_distance <= 200)::INT AS v FROM layers),
    {gauss_sql('g', 5.0)}, {filter_sql('n', 'v', 'g', 'smooth')} {scaled_sql('smooth', 'density')}""",
)
def w2_intersections(spark, folder):
    grid = fx.cell_grid(spark, folder)
    layers = distance_layers(spark, folder, grid)
    return round_columns(nb.intersection_density(layers, ["fault_distance", "shear_distance"], grid), ["density"])


CONTACT_SQL = (
    fx.CELLS_SQL
    + """,
contact_parts AS (
  SELECT c.row, c.col, CAST(coalesce(d.b0 <> c.b0, false) AS INT) AS down, CAST(coalesce(r.b0 <> c.b0, false) AS INT) AS "right"
  FROM cells c LEFT JOIN cells d ON d.col = c.col AND d.row = c.row + 1 LEFT JOIN cells r ON r.row = c.row AND r.col = c.col + 1),
contacts AS (SELECT row, col, CAST(least(down + "right", 1) AS DOUBLE) AS contact FROM contact_parts)"""
)


@query("j13_neighbour_compare", f'WITH {CONTACT_SQL} SELECT row, col, down, "right" FROM contact_parts')
def j13(spark, folder):
    return nb.neighbour_differs(fx.cells(spark, folder).select("row", "col", "b0"), "b0")


@query("w2c_contact_mask", f"WITH {CONTACT_SQL} SELECT row, col, contact FROM contacts")
def w2c(spark, folder):
    return nb.contact_mask(fx.cells(spark, folder).select("row", "col", "b0"), "b0")


@query(
    "w2_contact_density",
    f"WITH {CONTACT_SQL}, {gauss_sql('g', 20.0)}, {filter_sql('contacts', 'contact', 'g', 'smooth')} {scaled_sql('smooth', 'contact')}",
)
def w2_contacts(spark, folder):
    grid = fx.cell_grid(spark, folder)
    return round_columns(nb.contact_density(fx.cells(spark, folder).select("row", "col", "b0"), "b0", grid), ["contact"])


@query(
    "w3_local_variance_sum",
    f"""WITH {fx.CELLS_SQL}, g AS (SELECT k, 1.0::DOUBLE / 101 AS w FROM (SELECT unnest(range(-50, 51)) AS k)),
    src AS (SELECT row, col, b2, b2 * b2 AS q2, b3, b3 * b3 AS q3 FROM cells),
    {filter_sql('src', 'b2', 'g', 'm2')}, {filter_sql('src', 'q2', 'g', 's2')},
    {filter_sql('src', 'b3', 'g', 'm3')}, {filter_sql('src', 'q3', 'g', 's3')},
    total AS (SELECT m2.row, m2.col, greatest(s2.x - m2.x * m2.x, 0) + greatest(s3.x - m3.x * m3.x, 0) AS x
      FROM m2 JOIN s2 USING (row, col) JOIN m3 USING (row, col) JOIN s3 USING (row, col))
    {scaled_sql('total', 'complexity')}""",
)
def w3(spark, folder):
    grid = fx.cell_grid(spark, folder)
    return round_columns(nb.local_variance_sum(fx.cells(spark, folder).select("row", "col", "b2", "b3"), ["b2", "b3"], grid), ["complexity"])


def _suite_sql() -> str:
    """The layers of the suite side by side, each by the SQL of its own query."""
    near = ", ".join(f"CASE WHEN {d}_distance <= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {d}_near" for d in ("fault", "shear"))
    moments = [
        filter_sql("src", v, "g101", out)
        for v, out in (("f", "fm"), ("ff", "fs"), ("s", "sm"), ("ss", "ssm"))
    ]
    named = {
        "kf": "fault_distance_kde_density", "ks": "shear_distance_kde_density", "total": "structural_complexity",
        "cross_n": "intersection_density", "touch": "b0_contact_density",
    }
    scaled = ", ".join(f"{r}_scaled AS ({scaled_sql(r, name)})" for r, name in named.items())
    joins = " ".join(f"JOIN {r}_scaled USING (row, col)" for r in named)
    return f"""WITH {DISTANCE_SQL}, {CONTACT_SQL.removeprefix(fx.CELLS_SQL + ",")},
    src AS (SELECT row, col, {near}, (fault_distance <= 200)::INT + (shear_distance <= 200)::INT AS n, fault_distance AS f,
      fault_distance * fault_distance AS ff, shear_distance AS s, shear_distance * shear_distance AS ss FROM layers),
    {gauss_sql('g40', 40.0)}, {gauss_sql('g5', 5.0)}, {gauss_sql('g20', 20.0)},
    g101 AS (SELECT k, 1.0::DOUBLE / 101 AS w FROM (SELECT unnest(range(-50, 51)) AS k)),
    {filter_sql('src', 'fault_near', 'g40', 'kf')}, {filter_sql('src', 'shear_near', 'g40', 'ks')}, {filter_sql('src', 'n', 'g5', 'cross_n')},
    {filter_sql('contacts', 'contact', 'g20', 'touch')}, {", ".join(moments)},
    total AS (SELECT fm.row, fm.col, greatest(fs.x - fm.x * fm.x, 0) + greatest(ssm.x - sm.x * sm.x, 0) AS x
      FROM fm JOIN fs USING (row, col) JOIN sm USING (row, col) JOIN ssm USING (row, col)),
    hit AS (SELECT row, col FROM layers WHERE fault_distance <= 150 AND shear_distance <= 150),
    apart AS (SELECT l.row, l.col, {R('coalesce((SELECT sqrt(CAST(min((l.row - h.row) * (l.row - h.row) + (l.col - h.col) * (l.col - h.col)) AS DOUBLE)) * 50 FROM hit h), 0)')} AS intersection_distance
      FROM layers l),
    {scaled}
    SELECT row, col, {", ".join(named.values())}, intersection_distance FROM apart {joins}"""


@query("g10_feature_suite", _suite_sql())
def g10(spark, folder):
    grid = fx.cell_grid(spark, folder)
    base = fx.stored_cells(spark, folder).select("row", "col", "b0")
    layers = stored(distance_layers(spark, folder, grid).join(base, ["row", "col"]), "layers")
    suite = stack.feature_suite(layers, ["fault_distance", "shear_distance"], ["b0"], grid)
    return round_columns(suite, [c for c in suite.columns if c not in ("row", "col")])


# ---- resampling ----------------------------------------------------------

_TARGET = Grid(35.0, 20.0, 35.0 + 37.5 * 120, 20.0 + 37.5 * 180, 120, 180)


def _target_cells(spark, folder, grid):
    """Target addresses made from the cells: every source cell gives one target cell."""
    return fx.stored_cells(spark, folder).select("row", "col")


@query(
    "j6_regrid_bilinear",
    f"""WITH {fx.CELLS_SQL},
    target AS (
      SELECT row, col, (col + 0.5) * 37.5::DOUBLE / 50 + 0.7::DOUBLE - 0.5 AS u, (row + 0.5) * 37.5::DOUBLE / 50 + 0.4::DOUBLE - 0.5 AS v FROM cells),
    corner AS (
      SELECT t.row, t.col, CAST(floor(v) AS BIGINT) + dr AS sr, CAST(floor(u) AS BIGINT) + dc AS sc,
             (CASE WHEN dr = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE WHEN dc = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w
      FROM target t, dim, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc)
      WHERE v >= -0.5 AND v < h - 0.5 AND u >= -0.5 AND u < dim.w - 0.5),
    value AS (
      SELECT k.row, k.col, sum(k.w * s.b2) / sum(k.w) AS value FROM corner k JOIN cells s ON s.row = k.sr AND s.col = k.sc
      WHERE k.w > 0 AND s.b2 IS NOT NULL GROUP BY k.row, k.col)
    SELECT t.row, t.col, {R('value')} AS value FROM target t LEFT JOIN value v ON v.row = t.row AND v.col = t.col""",
)
def j6(spark, folder):
    grid = fx.cell_grid(spark, folder)
    base = fx.cells(spark, folder).select("row", "col", F.col("b2").alias("value"))
    u = (F.col("col") + 0.5) * 37.5 / 50 + 0.7
    v = (F.col("row") + 0.5) * 37.5 / 50 + 0.4
    out = nb.regrid_bilinear(base, grid, base.select("row", "col"), u, v)
    return round_columns(out, ["value"])


@query(
    "g9_stack_bands",
    f"""WITH {fx.CELLS_SQL},
    pct AS (SELECT quantile_cont(b1, 0.02) AS l1, quantile_cont(b1, 0.98) AS h1, quantile_cont(b2, 0.02) AS l2, quantile_cont(b2, 0.98) AS h2,
                   avg(b4) AS m4 FROM cells),
    scaled AS (SELECT row, col, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (b1 - l1) / (h1 - l1))) AS b1,
                      CASE WHEN b2 IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (b2 - l2) / (h2 - l2))) END AS b2, coalesce(b4, m4) AS b4 FROM cells, pct)
    SELECT row, col, {R('b1')} AS price, {R('coalesce(b2, (SELECT avg(b2) FROM scaled))')} AS quantity, {R('b4')} AS tax, 0.0::DOUBLE AS missing FROM scaled""",
)
def g9(spark, folder):
    grid = fx.cell_grid(spark, folder)
    base = fx.stored_cells(spark, folder)

    def layer(band):
        return base.select("row", "col", F.col(band).alias("value"))

    layers = [("price", layer("b1"), grid, True), ("quantity", layer("b2"), grid, True), ("tax", layer("b4"), grid, False), ("missing", None, None, True)]
    return round_columns(stack.stack_bands(spark, layers, grid), ["price", "quantity", "tax"])


@query(
    "g9_channel_stack",
    f"""WITH {fx.CELLS_SQL},
    pct AS (SELECT quantile_cont(b1, 0.02) AS l1, quantile_cont(b1, 0.98) AS h1, avg(b4) AS m4 FROM cells),
    scaled AS (SELECT row, col, CASE WHEN b1 IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (b1 - l1) / (h1 - l1))) END AS b1, coalesce(b4, m4) AS b4 FROM cells, pct)
    SELECT row, col, {', '.join({0: R('b4') + ' AS lithology_25k', 1: R('coalesce(b1, (SELECT avg(b1) FROM scaled))') + ' AS fault_dist_25k'}.get(i, f'0.0::DOUBLE AS "{c}"') for i, c in enumerate(CHANNELS))} FROM scaled""",
)
def channels(spark, folder):
    """Two of the fifteen channels have a layer; others of the inventory match none or are excluded."""
    base, root = fx.stored_cells(spark, folder), scratch_path(spark, "layers")
    written = {"Fault_25K_old": "b2", "fault_distance_25k": "b1", "litho_25k": "b4", "roads": "b3"}
    for name, band in written.items():
        base.select("row", "col", F.col(band).alias("value")).write.parquet(f"{root}/{name}")
    files = spark.createDataFrame([(f"{root}/{n}", n) for n in written], "path string, stem string")
    wanted = {"lithology_25k": (["lithology_25k", "litho"], []), "fault_dist_25k": (["fault"], ["old"])}
    listed = [(c, *wanted.get(c, ([f"absent_{c}"], [])), c != "lithology_25k") for c in CHANNELS]
    grid = fx.cell_grid(spark, folder)
    out = stack.channel_stack(spark, files, listed, lambda path: (spark.read.parquet(path), grid), grid)
    return round_columns(out, ["lithology_25k", "fault_dist_25k"])


# ---- wavenumber domain ---------------------------------------------------

_PI = repr(math.pi)

#: Separable transform by joins; `size` of the parts grid with a few unknown values.
DFT_SQL = (
    fx.PARTS_SQL
    + f""",
field AS (SELECT row, col, CASE WHEN (row * {fx.PART_WIDTH} + col) % 97 = 5 THEN NULL ELSE size END AS v FROM parts),
row_dft AS (
  SELECT f.row, k.col, sum(coalesce(f.v, 0) * cos(2 * {_PI} * ((f.col * k.col) % w) / w)) AS re, -sum(coalesce(f.v, 0) * sin(2 * {_PI} * ((f.col * k.col) % w) / w)) AS im
  FROM field f, (SELECT DISTINCT col FROM parts) k, pdim GROUP BY f.row, k.col),
spec AS (
  SELECT k.row, f.col, sum(f.re * cos(2 * {_PI} * ((f.row * k.row) % h) / h) + f.im * sin(2 * {_PI} * ((f.row * k.row) % h) / h)) AS re,
         sum(f.im * cos(2 * {_PI} * ((f.row * k.row) % h) / h) - f.re * sin(2 * {_PI} * ((f.row * k.row) % h) / h)) AS im
  FROM row_dft f, (SELECT DISTINCT row FROM parts) k, pdim GROUP BY k.row, f.col),
wave AS (
  SELECT row, col, re, im, 2 * {_PI} * (CASE WHEN col < (w + 1) // 2 THEN col ELSE col - w END) / (w * 50.0::DOUBLE) AS kx,
         2 * {_PI} * (CASE WHEN row < (h + 1) // 2 THEN row ELSE row - h END) / (h * 50.0::DOUBLE) AS ky FROM spec, pdim),
waves AS (SELECT *, CASE WHEN row = 0 AND col = 0 THEN 1e-10 ELSE sqrt(kx * kx + ky * ky) END AS k FROM wave),
fields AS (
  SELECT row, col, 'dx' AS f, -im * kx AS re, re * kx AS im FROM waves
  UNION ALL SELECT row, col, 'dy', -im * ky, re * ky FROM waves
  UNION ALL SELECT row, col, 'dz', re * k, im * k FROM waves
  UNION ALL SELECT row, col, 'up_500', re * exp(-k * 500), im * exp(-k * 500) FROM waves),
col_inv AS (
  SELECT f.f, k.row, f.col, sum(f.re * cos(2 * {_PI} * ((f.row * k.row) % h) / h) - f.im * sin(2 * {_PI} * ((f.row * k.row) % h) / h)) / max(h) AS re,
         sum(f.im * cos(2 * {_PI} * ((f.row * k.row) % h) / h) + f.re * sin(2 * {_PI} * ((f.row * k.row) % h) / h)) / max(h) AS im
  FROM fields f, (SELECT DISTINCT row FROM parts) k, pdim GROUP BY f.f, k.row, f.col),
inv AS (
  SELECT f.f, f.row, k.col, sum(f.re * cos(2 * {_PI} * ((f.col * k.col) % w) / w) - f.im * sin(2 * {_PI} * ((f.col * k.col) % w) / w)) / max(w) AS x
  FROM col_inv f, (SELECT DISTINCT col FROM parts) k, pdim GROUP BY f.f, f.row, k.col),
wide AS (
  SELECT row, col, max(x) FILTER (WHERE f = 'dx') AS dx, max(x) FILTER (WHERE f = 'dy') AS dy, max(x) FILTER (WHERE f = 'dz') AS dz,
         max(x) FILTER (WHERE f = 'up_500') AS up_500 FROM inv GROUP BY row, col),
known AS (SELECT w.* FROM wide w JOIN field f ON f.row = w.row AND f.col = w.col WHERE f.v IS NOT NULL),
addresses AS (SELECT row, col FROM parts)"""
)


def _field(spark, folder):
    hole = (F.col("row") * fx.PART_WIDTH + F.col("col")) % 97 == 5
    return fx.parts(spark, folder).select("row", "col", F.when(~hole, F.col("size")).alias("v"))


def _products(spark, folder, heights=()):
    grid = fx.part_grid(spark, folder)
    field = _field(spark, folder)
    return spectral.where_known(spectral.derivatives(spectral.spectrum(field, "v", grid), grid, heights), field, "v")


def _spectral_sql(expression: str, name: str) -> str:
    return f"WITH {DFT_SQL} SELECT a.row, a.col, {R(expression)} AS {name} FROM addresses a LEFT JOIN known k ON k.row = a.row AND k.col = a.col"


@query("g1_fft2", f"WITH {DFT_SQL} SELECT row, col, {R('re')} AS re, {R('im')} AS im FROM spec")
def g1(spark, folder):
    return round_columns(spectral.spectrum(_field(spark, folder), "v", fx.part_grid(spark, folder)), ["re", "im"])


@query("g1_fft2_roundtrip", f"WITH {fx.PARTS_SQL} SELECT row, col, {R('price', 4)} AS price FROM parts")
def g1_back(spark, folder):
    grid = fx.part_grid(spark, folder)
    spec = spectral.spectrum(fx.parts(spark, folder), "price", grid)
    named = spec.select("row", "col", F.col("re").alias("price_re"), F.col("im").alias("price_im"))
    return round_columns(spectral.inverse_spectrum(named, ["price"], grid), ["price"], 4)


@query("g2_first_vertical_derivative", _spectral_sql("dz", "vd1"))
def g2(spark, folder):
    return _products(spark, folder).select("row", "col", rounded(spectral.first_vertical_derivative()).alias("vd1"))


@query("g3_analytic_signal", _spectral_sql("sqrt(dx * dx + dy * dy + dz * dz)", "asa"))
def g3(spark, folder):
    return _products(spark, folder).select("row", "col", rounded(spectral.analytic_signal()).alias("asa"))


@query("g4_tilt_derivative", _spectral_sql("atan2(dz, greatest(sqrt(dx * dx + dy * dy), 1e-10))", "tdr"))
def g4(spark, folder):
    return _products(spark, folder).select("row", "col", rounded(spectral.tilt_derivative()).alias("tdr"))


@query("g5_upward_continuation", _spectral_sql("up_500", "up_500"))
def g5(spark, folder):
    return _products(spark, folder, [500]).select("row", "col", rounded("up_500").alias("up_500"))


# ---- trend and filtering -------------------------------------------------

#: Normal equations of 1, x, y solved by Cramer's rule.
TREND_SQL = (
    fx.PARTS_SQL
    + """,
t AS (SELECT row, col, price AS v, -1 + col * (2.0::DOUBLE / (w - 1)) AS x, -1 + row * (2.0::DOUBLE / (h - 1)) AS y FROM parts, pdim),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(v) AS v, sum(x * v) AS xv, sum(y * v) AS yv FROM t),
d AS (SELECT *, n * (xx * yy - xy * xy) - x * (x * yy - xy * y) + y * (x * xy - xx * y) AS det FROM s),
c AS (SELECT (v * (xx * yy - xy * xy) - x * (xv * yy - xy * yv) + y * (xv * xy - xx * yv)) / det AS c0,
             (n * (xv * yy - xy * yv) - v * (x * yy - xy * y) + y * (x * yv - xv * y)) / det AS c1,
             (n * (xx * yv - xv * xy) - x * (x * yv - xv * y) + v * (x * xy - xx * y)) / det AS c2 FROM d)"""
)


@query(
    "a13_poly_trend_plane",
    f"WITH {TREND_SQL} SELECT row, col, {R('c0 + c1 * t.x + c2 * t.y', 5)} AS regional, {R('t.v - (c0 + c1 * t.x + c2 * t.y)', 5)} AS residual FROM t, c",
)
def a13(spark, folder):
    grid = fx.part_grid(spark, folder)
    return round_columns(spectral.trend_residual(fx.parts(spark, folder), "price", grid, degree=1), ["regional", "residual"], 5)


#: Normal equations of the ten monomials up to degree 3, solved by elimination in a recursive query.
CUBIC_SQL = (
    fx.CELLS_SQL
    + """,
t AS (SELECT row, col, CAST(b2 AS DOUBLE) AS v, -1 + col * (2.0::DOUBLE / (w - 1)) AS x, -1 + row * (2.0::DOUBLE / (h - 1)) AS y FROM cells, dim),
m AS (SELECT row, col, v, [1.0::DOUBLE, x, x * x, x * x * x, y, x * y, x * x * y, y * y, x * y * y, y * y * y, v] AS p FROM t WHERE v IS NOT NULL),
sums AS (SELECT i, j, sum(p[i] * p[j]) AS s FROM m, range(1, 11) a(i), range(1, 12) b(j) GROUP BY i, j),
lines AS (SELECT i, list(s ORDER BY j) AS line FROM sums GROUP BY i),
steps AS (
  SELECT 1::BIGINT AS k, list(line ORDER BY i) AS g FROM lines
  UNION ALL
  SELECT k + 1, list_transform(range(1, 11), lambda i: list_transform(range(1, 12), lambda j:
    CASE WHEN i = k THEN g[k][j] / g[k][k] ELSE g[i][j] - g[i][k] * g[k][j] / g[k][k] END)) FROM steps WHERE k <= 10),
fit AS (SELECT list_transform(g, lambda line: line[11]) AS c FROM steps WHERE k = 11),
surface AS (SELECT row, col, v, list_inner_product(p[1:10], c) AS regional FROM m, fit)"""
)


@query(
    "g7_trend_residual",
    f"""WITH RECURSIVE {CUBIC_SQL}
    SELECT t.row, t.col, {R('s.regional', 5)} AS regional, {R('s.v - s.regional', 5)} AS residual FROM t LEFT JOIN surface s ON t.row = s.row AND t.col = s.col""",
)
def g7(spark, folder):
    grid = fx.cell_grid(spark, folder)
    cells = fx.stored_cells(spark, folder).select("row", "col", "b2")
    return round_columns(spectral.trend_residual(cells, "b2", grid), ["regional", "residual"], 5)


@query("g6_svd_lowrank")
def g6(spark, folder):
    return spectral.svd_lowrank(fx.stored_cells(spark, folder).select("row", "col", "b2"), "b2", fx.cell_grid(spark, folder))


@query(
    "g6_svd_lowrank_rank2",
    f"""WITH {fx.CELLS_SQL}, r AS (SELECT row, coalesce(avg(b2), 0) AS a FROM cells GROUP BY row), c AS (SELECT col, coalesce(avg(b2), 0) AS b FROM cells GROUP BY col)
    SELECT cells.row, cells.col, {R('a + b', 5)} AS filtered FROM cells JOIN r ON r.row = cells.row JOIN c ON c.col = cells.col""",
)
def g6_rank2(spark, folder):
    """Means of lines plus means of columns, a field of rank two, which a filter of rank two gives back."""
    cells = fx.stored_cells(spark, folder).select("row", "col", "b2")
    of_rows = cells.groupBy("row").agg(F.coalesce(F.avg("b2"), F.lit(0.0)).alias("a"))
    of_cols = cells.groupBy("col").agg(F.coalesce(F.avg("b2"), F.lit(0.0)).alias("b"))
    field = cells.select("row", "col").join(of_rows, "row").join(of_cols, "col").select("row", "col", (F.col("a") + F.col("b")).alias("v"))
    return round_columns(spectral.svd_lowrank(field, "v", fx.cell_grid(spark, folder), rank=2), ["filtered"], 5)


@query("g8_potential_field_suite")
def g8(spark, folder):
    return stack.potential_field_suite(fx.stored_cells(spark, folder).select("row", "col", "b2"), "b2", fx.cell_grid(spark, folder))
