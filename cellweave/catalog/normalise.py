"""Queries: scaling, imputation, evidence weights, labels, folds and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.catalog import fixtures as fx
from cellweave.catalog.registry import R, query, round_columns, rounded
from cellweave.functions.scalars import all_present
from cellweave.operators import evidence, labels, normalize
from cellweave.plans import baselines

BANDS = fx.BANDS


def _pct(p: float, band: str = "value") -> str:
    return f"quantile_cont({band}, {p})"


# ---- scans ---------------------------------------------------------------


def _sentinel(spark, folder):
    return fx.cells(spark, folder).na.fill(-9999.0, BANDS)


@query(
    "s6_nodata_to_null",
    f"WITH {fx.CELLS_SQL} SELECT row, col, b1, b2, b3, b4, b5 FROM cells",
)
def s6(spark, folder):
    from cellweave.sources.rasters import nodata_to_null

    return nodata_to_null(_sentinel(spark, folder), BANDS).select("row", "col", *BANDS)


@query(
    "s7_nodata_to_zero",
    f"WITH {fx.CELLS_SQL} SELECT row, col, {', '.join(f'coalesce({b}, 0.0::DOUBLE) AS {b}' for b in BANDS)} FROM cells",
)
def s7(spark, folder):
    from cellweave.sources.rasters import nodata_to_zero

    return nodata_to_zero(_sentinel(spark, folder), BANDS).select("row", "col", *BANDS)


@query(
    "c8_valid_all_bands",
    f"WITH {fx.CELLS_SQL} SELECT row, col FROM cells WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND b4 IS NOT NULL AND b5 IS NOT NULL",
)
def c8(spark, folder):
    return fx.cells(spark, folder).where(all_present(BANDS)).select("row", "col")


# ---- normalisation -------------------------------------------------------


def _stretch_sql(eps: str, fill: str = "") -> str:
    cols = ", ".join(f"{_pct(0.02, b)} AS lo_{b}, {_pct(0.98, b)} AS hi_{b}" for b in BANDS)
    out = []
    for b in BANDS:
        e = f"CASE WHEN {b} IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({b} - lo_{b}) / (hi_{b} - lo_{b}{eps}))) END"
        e = f"coalesce({e}, 0)" if fill else e
        out.append(f"{R(e)} AS {b}")
    return f"WITH {fx.CELLS_SQL}, pct AS (SELECT {cols} FROM cells) SELECT row, col, {', '.join(out)} FROM cells, pct"


@query("a1_robust_normalize", _stretch_sql(" + 1e-8"))
def a1(spark, folder):
    out = normalize.robust_normalize(fx.stored_cells(spark, folder).select("row", "col", *BANDS), BANDS)
    return round_columns(out, BANDS)


@query("a1_normalize_channels", _stretch_sql(""))
def a1_stack(spark, folder):
    out = normalize.normalize_channels(fx.stored_cells(spark, folder).select("row", "col", *BANDS), BANDS)
    return round_columns(out, BANDS)


@query("c19_rgb_composite", _stretch_sql(" + 1e-9", "fill"))
def c19(spark, folder):
    out = normalize.rgb_composite(fx.stored_cells(spark, folder).select("row", "col", *BANDS), BANDS)
    return round_columns(out, BANDS)


@query(
    "a2_mean_impute",
    f"WITH {fx.CELLS_SQL}, m AS (SELECT {', '.join(f'avg({b}) AS m_{b}' for b in BANDS)} FROM cells) "
    f"SELECT row, col, {', '.join(R(f'coalesce({b}, m_{b})') + f' AS {b}' for b in BANDS)} FROM cells, m",
)
def a2(spark, folder):
    return round_columns(normalize.mean_impute(fx.stored_cells(spark, folder).select("row", "col", *BANDS), BANDS), BANDS)


@query(
    "a3_median_impute",
    f"""WITH {fx.CELLS_SQL},
    part AS (SELECT *, CASE WHEN col < 60 THEN 'train' WHEN col < 80 THEN 'validation' ELSE 'predict' END AS part FROM cells),
    learned AS (SELECT {', '.join(f'median({b}) AS t_{b}' for b in BANDS)} FROM part WHERE part = 'train'),
    own AS (SELECT {', '.join(f'median({b}) AS v_{b}' for b in BANDS)} FROM part WHERE part = 'validation')
    SELECT row, col, part, {', '.join(R(f"coalesce({b}, CASE WHEN part = 'validation' THEN v_{b} END, t_{b})") + f' AS {b}' for b in BANDS)}
    FROM part, learned, own""",
)
def a3(spark, folder):
    base = fx.stored_cells(spark, folder).select("row", "col", *BANDS)
    parts = [base.where("col < 60"), base.where("col >= 60 AND col < 80"), base.where("col >= 80")]
    filled = normalize.median_impute(*parts, BANDS)
    named = [df.withColumn("part", F.lit(n)) for df, n in zip(filled, ("train", "validation", "predict"))]
    return round_columns(reduce(DataFrame.unionByName, named), BANDS)


@query(
    "a4_standardize",
    f"""WITH {fx.CELLS_SQL},
    fitted AS (SELECT {', '.join(f'avg({b}) AS m_{b}, stddev_pop({b}) AS s_{b}' for b in BANDS)} FROM cells WHERE col < 60)
    SELECT row, col, {', '.join(R(f'({b} - m_{b}) / (CASE WHEN s_{b} = 0 THEN 1 ELSE s_{b} END)') + f' AS {b}' for b in BANDS)}
    FROM cells, fitted""",
)
def a4(spark, folder):
    base = fx.stored_cells(spark, folder).select("row", "col", *BANDS)
    return round_columns(normalize.standardize(base, normalize.standardize_fit(base.where("col < 60"), BANDS)), BANDS)


@query(
    "a5_max_normalize",
    f"""WITH {fx.CELLS_SQL}, top AS (SELECT max(b1) AS m1, max(b2) AS m2, max(b5) AS m5 FROM cells)
    SELECT row, col, {R('CASE WHEN m1 > 0 THEN b1 / m1 ELSE b1 END')} AS b1, {R('CASE WHEN m2 > 0 THEN b2 / m2 ELSE b2 END')} AS b2,
           {R('CASE WHEN m5 > 0 THEN b5 / m5 ELSE b5 END')} AS b5 FROM cells, top""",
)
def a5(spark, folder):
    from cellweave.operators.neighbourhood import max_normalize

    columns = ["b1", "b2", "b5"]
    return round_columns(max_normalize(fx.stored_cells(spark, folder).select("row", "col", *columns), columns), columns)


@query(
    "j12_scalar_broadcast",
    f"WITH {fx.CELLS_SQL} SELECT row, col, {R('(b1 - (SELECT avg(b1) FROM cells)) / (SELECT max(b1) - min(b1) FROM cells)')} AS b1 FROM cells",
)
def j12(spark, folder):
    base = fx.stored_cells(spark, folder).select("row", "col", "b1")
    centre = base.agg(F.avg("b1")).scalar()
    span = base.agg(F.max("b1") - F.min("b1")).scalar()
    return base.select("row", "col", rounded((F.col("b1") - centre) / span).alias("b1"))


@query(
    "c14_channel_groups",
    f"WITH {fx.CELLS_SQL} SELECT row, col, b1, b2, 0.0::DOUBLE AS b3, 0.0::DOUBLE AS b4 FROM cells",
)
def c14(spark, folder):
    from cellweave.functions.categories import group_bands

    kept = [b for b in group_bands("geological_25k") if b in ("b1", "b2")]
    dropped = [b for b in group_bands("geological_25k") if b in ("b3", "b4")]
    return fx.cells(spark, folder).select("row", "col", *kept, *[F.lit(0.0).alias(b) for b in dropped])


# ---- weights of evidence -------------------------------------------------

WOE_SQL = (
    fx.LONG_SQL
    + """,
rich AS (
  SELECT band, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q
  FROM cells_long WHERE value > 0 GROUP BY band HAVING count(*) >= 100),
poor AS (
  SELECT band, [median(value)] AS q FROM cells_long
  WHERE value IS NOT NULL AND band NOT IN (SELECT band FROM rich) GROUP BY band),
thr AS (
  SELECT DISTINCT band, round(t, 6) AS thr
  FROM (SELECT band, unnest(q) AS t FROM (SELECT * FROM rich UNION ALL SELECT * FROM poor))),
counts AS (
  SELECT t.band, t.thr, CAST(count(*) AS DOUBLE) AS n_total, CAST(sum(label) AS DOUBLE) AS n_dep,
         CAST(count(*) FILTER (WHERE value >= thr) AS DOUBLE) AS n_b,
         CAST(count(*) FILTER (WHERE value >= thr AND label = 1) AS DOUBLE) AS db,
         CAST(count(*) FILTER (WHERE value < thr AND label = 1) AS DOUBLE) AS dnb
  FROM thr t JOIN cells_long l ON l.band = t.band JOIN cells c ON c.row = l.row AND c.col = l.col
  WHERE l.value IS NOT NULL GROUP BY t.band, t.thr),
floored AS (
  SELECT band, thr, n_total, n_dep, n_b, greatest(db, 0.5) AS n_db, greatest(dnb, 0.5) AS n_dnb FROM counts
  WHERE n_b >= 10 AND n_total - n_b >= 10 AND n_dep >= 10 AND n_total - n_dep >= 100),
contingency AS (
  SELECT *, greatest(n_b - n_db, 0.5) AS n_ndb, greatest(n_total - n_b - n_dnb, 0.5) AS n_ndnb FROM floored),
weights AS (
  SELECT *, ln((n_db / n_dep) / (n_ndb / (n_total - n_dep))) AS w_plus,
         ln((n_dnb / n_dep) / (n_ndnb / (n_total - n_dep))) AS w_minus,
         sqrt(1 / n_db + 1 / n_ndb + 1 / n_dnb + 1 / n_ndnb) AS dev FROM contingency),
contrasts AS (SELECT *, w_plus - w_minus AS contrast, (w_plus - w_minus) / (dev + 1e-8) AS studentized FROM weights),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY round(abs(contrast), 9) DESC, thr) AS k FROM contrasts)
  WHERE k = 1),
prior AS (
  SELECT ln(CAST(sum(label) AS DOUBLE) / greatest(count(*) - sum(label), 1) + 1e-8) AS p FROM cells WHERE b1 IS NOT NULL),
logits AS (
  SELECT l.row, l.col, sum(CASE WHEN value >= thr THEN w_plus WHEN value < thr THEN w_minus ELSE 0 END) AS s
  FROM cells_long l JOIN best b ON l.band = b.band GROUP BY l.row, l.col),
posterior AS (
  SELECT c.row, c.col, c.label, 1 / (1 + exp(-(p + s))) AS posterior
  FROM cells c JOIN logits g ON c.row = g.row AND c.col = g.col, prior)"""
)

_COUNTS = "n_total, n_dep, n_b, n_db, n_dnb, n_ndb, n_ndnb"


@query("a9_woe_contingency", f"WITH {WOE_SQL} SELECT band, thr, {_COUNTS} FROM contingency")
def a9(spark, folder):
    cells = fx.stored_cells(spark, folder).select("label", *BANDS)
    return evidence.woe_contingency(cells, BANDS, evidence.band_thresholds(cells, BANDS, 6))


@query(
    "a10_woe_weights",
    f"WITH {WOE_SQL} SELECT band, thr, {R('w_plus')} AS w_plus, {R('w_minus')} AS w_minus, {R('contrast')} AS contrast, {R('studentized')} AS studentized FROM contrasts",
)
def a10(spark, folder):
    cells = fx.stored_cells(spark, folder).select("label", *BANDS)
    weights = evidence.woe_weights(evidence.woe_contingency(cells, BANDS, evidence.band_thresholds(cells, BANDS, 6)))
    return round_columns(
        weights.select("band", "thr", "w_plus", "w_minus", "contrast", "studentized"), ["w_plus", "w_minus", "contrast", "studentized"]
    )


@query(
    "a11_woe_best_threshold",
    f"WITH {WOE_SQL} SELECT band, thr, {R('w_plus')} AS w_plus, {R('w_minus')} AS w_minus, {R('contrast')} AS contrast, "
    f"{R('studentized')} AS studentized, abs(studentized) >= 1.5 AS significant FROM best",
)
def a11(spark, folder):
    best = evidence.woe_fit(fx.stored_cells(spark, folder).select("label", *BANDS), BANDS, decimals=6)
    columns = ["w_plus", "w_minus", "contrast", "studentized"]
    return round_columns(best.select("band", "thr", *columns, "significant"), columns)


@query("a12_woe_posterior", f"WITH {WOE_SQL} SELECT row, col, label, {R('posterior')} AS posterior FROM posterior")
def a12(spark, folder):
    cells = fx.stored_cells(spark, folder).select("row", "col", "label", *BANDS)
    scored = evidence.woe_posterior(cells, evidence.woe_fit(cells, BANDS, decimals=6), "b1")
    return scored.select("row", "col", "label", rounded("posterior").alias("posterior"))


# ---- labels and folds ----------------------------------------------------


@query(
    "j1_label_band_join",
    f"""WITH {fx.CELLS_SQL}, {fx.FOLDS_SQL}, mask AS (SELECT row, col, true AS mask FROM fold_cells WHERE fold = 1 AND region = 'test')
    SELECT c.row, c.col, b1, b2, CAST(CASE WHEN b5 > 0 THEN label ELSE 0 END AS BIGINT) AS label, mask FROM cells c LEFT JOIN mask m ON c.row = m.row AND c.col = m.col""",
)
def j1(spark, folder):
    base, grid = fx.cells(spark, folder), fx.cell_grid(spark, folder)
    known = base.where("b5 > 0").select("row", "col", "label")
    masks = (
        labels.spatial_folds(base.select("row", "col"), fx.strips(grid))
        .where("fold = 1 AND region = 'test'")
        .select("row", "col", F.lit(True).alias("mask"))
    )
    return labels.label_bands(base.select("row", "col", "b1", "b2"), known, masks)


@query(
    "a8_label_balance",
    f"""WITH {fx.CELLS_SQL} SELECT count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_unlabeled,
    count(*) AS n, {R('100.0 * count(*) FILTER (WHERE label = 1) / count(*)')} AS pct_positive,
    {R('100.0 * count(*) FILTER (WHERE label = 0) / count(*)')} AS pct_unlabeled FROM cells""",
)
def a8(spark, folder):
    return round_columns(labels.label_balance(fx.cells(spark, folder)), ["pct_positive", "pct_unlabeled"])


@query(
    "c10_spatial_folds",
    f"WITH {fx.CELLS_SQL}, {fx.FOLDS_SQL} SELECT row, col, label, fold, region FROM fold_cells",
)
def c10(spark, folder):
    grid = fx.cell_grid(spark, folder)
    return labels.spatial_folds(fx.cells(spark, folder).select("row", "col", "label"), fx.strips(grid))


@query(
    "c10_fold_masks",
    f"""WITH {fx.CELLS_SQL}, {fx.FOLDS_SQL}
    SELECT fold, region || '_region' AS kind, row, col FROM fold_cells
    UNION ALL SELECT fold, region || '_pos', row, col FROM fold_cells WHERE label = 1
    UNION ALL SELECT fold, 'train_unl', row, col FROM fold_cells WHERE label = 0 AND region = 'train'""",
)
def c10_masks(spark, folder):
    return labels.fold_masks(fx.cells(spark, folder), fx.strips(fx.cell_grid(spark, folder)))


@query(
    "c10_fold_counts",
    f"""WITH {fx.CELLS_SQL}, {fx.FOLDS_SQL}
    SELECT fold, count(*) FILTER (WHERE region = 'test' AND label = 1) AS n_test_pos,
           count(*) FILTER (WHERE region = 'train' AND label = 1) AS n_train_pos,
           count(*) FILTER (WHERE region = 'train' AND label = 0) AS n_train_unl FROM fold_cells GROUP BY fold""",
)
def c10_counts(spark, folder):
    return labels.fold_counts(fx.cells(spark, folder), fx.strips(fx.cell_grid(spark, folder)))


@query(
    "c9_interior_cells",
    f"WITH {fx.CELLS_SQL} SELECT row, col, label FROM cells, dim WHERE row >= 4 AND row < h - 4 AND col >= 4 AND col < w - 4 AND b2 > 0",
)
def c9(spark, folder):
    grid = fx.cell_grid(spark, folder)
    return labels.interior(fx.cells(spark, folder), 4, grid.height, grid.width).where("b2 > 0").select("row", "col", "label")


@query("u3_mask_intersect", f"WITH {fx.CELLS_SQL}, {fx.FOLDS_SQL} SELECT row, col FROM cells WHERE label = 1 INTERSECT SELECT row, col FROM fold_cells WHERE fold = 2 AND region = 'train'")
def u3(spark, folder):
    base = fx.stored_cells(spark, folder)
    mask = labels.spatial_folds(base, fx.strips(fx.cell_grid(spark, folder))).where("fold = 2 AND region = 'train'")
    return base.where("label = 1").select("row", "col").join(mask.select("row", "col"), ["row", "col"], "left_semi")


# ---- sampling ------------------------------------------------------------


def _key(seed: str) -> str:
    return f"md5(row || '-' || col || '-' || {seed})"


def _sample_sql(source: str, ratio: int, seed: str, by: str = "") -> str:
    part = f"{by}, label" if by else "label"
    grouping = f"PARTITION BY {by}" if by else ""
    return f"""ranked AS (
      SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {_key(seed)}, row, col) AS k,
             sum(label) OVER ({grouping}) AS n_pos FROM {source}),
    sampled AS (SELECT * FROM ranked WHERE label = 1 OR k <= n_pos * {ratio})"""


@query(
    "w5_stratified_sample",
    f"WITH {fx.CELLS_SQL}, {_sample_sql('cells', 2, '42')} SELECT row, col, label, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS weight FROM sampled",
)
def w5(spark, folder):
    return labels.with_weights(labels.stratified_sample(fx.stored_cells(spark, folder).select("row", "col", "label"), 2, 42))


@query(
    "w5_stratified_sample_per_fold",
    f"""WITH {fx.CELLS_SQL}, {fx.FOLDS_SQL}, test AS (SELECT * FROM fold_cells WHERE region = 'test'), {_sample_sql('test', 3, '(42 + fold)', 'fold')}
    SELECT fold, row, col, label FROM sampled""",
)
def w5_fold(spark, folder):
    used = labels.spatial_folds(fx.stored_cells(spark, folder).select("row", "col", "label"), fx.strips(fx.cell_grid(spark, folder)))
    sample = labels.stratified_sample(used.where("region = 'test'"), 3, F.lit(42) + F.col("fold"), by=["fold"])
    return sample.select("fold", "row", "col", "label")


@query(
    "w6_epoch_resample",
    " UNION ALL ".join(
        f"(WITH {fx.CELLS_SQL}, {_sample_sql('cells', 1, str(42 + e))} SELECT {e}::BIGINT AS epoch, row, col FROM sampled WHERE label = 0)" for e in range(3)
    ),
)
def w6(spark, folder):
    base = fx.stored_cells(spark, folder).select("row", "col", "label")
    epochs = F.explode(F.array(*[F.lit(e).cast("bigint") for e in range(3)]))
    drawn = labels.stratified_sample(base.withColumn("epoch", epochs), 1, F.lit(42) + F.col("epoch"), by=["epoch"])
    return drawn.where("label = 0").select("epoch", "row", "col")


@query(
    "u2_positives_and_unlabeled",
    f"""WITH {fx.CELLS_SQL} SELECT row, col, 1::BIGINT AS label, 1.0::DOUBLE AS weight FROM cells WHERE label = 1
    UNION ALL SELECT row, col, 0::BIGINT, 0.1::DOUBLE FROM cells WHERE label = 0 AND b5 > 0""",
)
def u2(spark, folder):
    base = fx.cells(spark, folder)
    return labels.positives_and_unlabeled(base.where("label = 1"), base.where("label = 0 AND b5 > 0"))


@query(
    "w8_random_split",
    f"""WITH {fx.CELLS_SQL}, tiles AS (SELECT row, col FROM cells WHERE row % 4 = 0 AND col % 4 = 0),
    ranked AS (SELECT *, row_number() OVER (ORDER BY {_key('42')}, row, col) AS k, count(*) OVER () AS n FROM tiles)
    SELECT row, col, CASE WHEN k <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM ranked""",
)
def w8(spark, folder):
    tiles = fx.stored_cells(spark, folder).where("row % 4 = 0 AND col % 4 = 0").select("row", "col")
    return labels.random_split(tiles, 42)


@query(
    "t4_sample_caps",
    f"""WITH {fx.CELLS_SQL}, valid AS (SELECT row, col, label FROM cells WHERE b2 IS NOT NULL AND b4 IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key('7')}, row, col) AS k, sum(label) OVER () AS n_pos FROM valid)
    SELECT row, col, label FROM ranked WHERE k <= CASE WHEN label = 1 THEN 100 ELSE 500 END AND (label = 1 OR k <= n_pos * 5)""",
)
def t4(spark, folder):
    """The bound on the labelled rows of a fit: at most 100 positives, and five unlabeled rows for each."""
    valid = fx.stored_cells(spark, folder).where(all_present(["b2", "b4"])).select("row", "col", "label")
    return labels.stratified_sample(valid, 5, 7, cap=100)


@query(
    "j14_weighted_draw",
    f"""WITH {fx.CELLS_SQL}, items AS (
      SELECT row, col, label, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS weight,
             CASE WHEN label = 1 THEN 1000000 ELSE 100000 END AS units, row * {fx.WIDTH} + col AS id FROM cells),
    slices AS (SELECT *, sum(units) OVER (ORDER BY id) AS high, sum(units) OVER () AS total, count(*) OVER () AS n FROM items),
    draws AS (SELECT d AS draw, CAST('0x' || substr(md5(d || '-42'), 1, 15) AS BIGINT) % (SELECT any_value(total) FROM slices) AS at_pos
              FROM (SELECT unnest(range(0, (SELECT any_value(n) FROM slices))) AS d))
    SELECT row, col, label, weight, CAST(id AS BIGINT) AS id, CAST(draw AS BIGINT) AS draw FROM slices JOIN draws ON at_pos >= high - units AND at_pos < high""",
)
def j14(spark, folder):
    base = labels.with_weights(fx.stored_cells(spark, folder).select("row", "col", "label"))
    keyed = base.withColumn("id", F.col("row") * fx.WIDTH + F.col("col"))
    return labels.weighted_draw(keyed, "weight", "id")


METRICS_SQL = """
  dist AS (SELECT fold, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) - sum(label) AS DOUBLE) AS neg FROM ev GROUP BY fold, score),
  run AS (
    SELECT *, sum(pos) OVER d AS cp, sum(neg) OVER d AS cn, sum(neg) OVER a AS below FROM dist
    WINDOW d AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY fold ORDER BY score ROWS UNBOUNDED PRECEDING)),
  aucs AS (
    SELECT fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * cp / (cp + cn)) / sum(pos) ELSE 0 END AS auc_pr,
           CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)) ELSE 0 END AS auc_roc
    FROM run GROUP BY fold),
  thresholds AS (SELECT i AS step, CASE WHEN i = 49 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE + i * (0.98::DOUBLE / 49) END AS threshold FROM (SELECT unnest(range(0, 50)) AS i)),
  cross_counts AS (
    SELECT fold, step, threshold, CAST(sum(CASE WHEN score >= threshold THEN pos ELSE 0 END) AS DOUBLE) AS tp,
           CAST(sum(CASE WHEN score >= threshold THEN neg ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n
    FROM dist, thresholds GROUP BY fold, step, threshold),
  sweep AS (
    SELECT fold, step, threshold, tp, fp, p - tp AS fn, n - fp AS tn,
           CASE WHEN 2 * tp + fp + p - tp <> 0 THEN 2 * tp / (2 * tp + fp + (p - tp)) ELSE 0 END AS f1,
           CASE WHEN (tp + fp) * p * n * ((p - tp) + (n - fp)) > 0
                THEN (tp * (n - fp) - fp * (p - tp)) / sqrt((tp + fp) * p * n * ((p - tp) + (n - fp))) ELSE 0 END AS mcc
    FROM cross_counts WHERE tp + fp > 0),
  top AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, step) AS k FROM sweep WHERE f1 > 0 AND tp + fn > 0 AND fp + tn > 0) WHERE k = 1)"""

EVALUATE_SQL = f"""SELECT a.fold, {R('auc_pr')} AS auc_pr, {R('auc_roc')} AS auc_roc, {R('coalesce(threshold, 0.5)')} AS threshold,
  {R('coalesce(f1, 0)')} AS f1, {R('coalesce(mcc, 0)')} AS mcc FROM aucs a LEFT JOIN top t ON a.fold = t.fold"""


@query(
    "m9_woe_baseline",
    f"""WITH {WOE_SQL}, {fx.FOLDS_SQL.replace('fold_cells AS', 'unused AS')},
    test AS (SELECT p.row, p.col, p.label, round(posterior, 9) AS score, fold FROM posterior p JOIN folds ON col >= s AND col < e),
    {_sample_sql('test', 10, '(42 + fold)', 'fold')},
    ev AS (SELECT fold, label, score FROM sampled), {METRICS_SQL} {EVALUATE_SQL}""",
)
def m9(spark, folder):
    cells, grid = fx.stored_cells(spark, folder), fx.cell_grid(spark, folder)
    out = baselines.woe_baseline(cells, BANDS, fx.strips(grid), score_decimals=9, decimals=6)
    return round_columns(out, ["auc_pr", "auc_roc", "threshold", "f1", "mcc"])
