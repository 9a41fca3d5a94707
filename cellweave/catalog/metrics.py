"""Queries: ranking metrics, rank tests, group statistics, curves, tiers, run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.catalog import fixtures as fx
from cellweave.catalog.normalise import EVALUATE_SQL, METRICS_SQL
from cellweave.catalog.registry import R, query, round_columns, rounded
from cellweave.functions import categories
from cellweave.functions.scalars import linspace, sigmoid_clipped
from cellweave.operators import metrics, points, runs
from cellweave.operators.tiles import mc_mean_std
from cellweave.session import stored

EVAL_SQL = f"{fx.CELLS_SQL}, {fx.FOLDS_SQL}, ev AS (SELECT fold, label, {R('least(1.0, greatest(0.0, coalesce(b2, 0) / 350.0::DOUBLE))', 4)} AS score FROM fold_cells WHERE region = 'test'), {METRICS_SQL}"


def fold_scores(spark, folder):
    from cellweave.operators.labels import spatial_folds

    grid = fx.cell_grid(spark, folder)
    return spatial_folds(fx.scored(spark, folder), fx.strips(grid)).where("region = 'test'")


@query("a18_auc_pr", f"WITH {EVAL_SQL} SELECT fold, {R('auc_pr')} AS auc_pr FROM aucs")
def a18(spark, folder):
    return round_columns(metrics.auc_pr(fold_scores(spark, folder), by=["fold"]), ["auc_pr"])


@query("a19_auc_roc", f"WITH {EVAL_SQL} SELECT fold, {R('auc_roc')} AS auc_roc FROM aucs")
def a19(spark, folder):
    return round_columns(metrics.auc_roc(fold_scores(spark, folder), by=["fold"]), ["auc_roc"])


@query(
    "a20_threshold_sweep",
    f"""WITH {EVAL_SQL} SELECT fold, step, {R('threshold')} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
    CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {R('f1')} AS f1, {R('mcc')} AS mcc FROM sweep""",
)
def a20(spark, folder):
    sweep = metrics.threshold_sweep(fold_scores(spark, folder), by=["fold"])
    return round_columns(sweep.withColumn("step", F.col("step").cast("bigint")), ["threshold", "f1", "mcc"])


@query("a21_best_threshold", f"WITH {EVAL_SQL} SELECT fold, {R('threshold')} AS threshold, {R('f1')} AS f1, {R('mcc')} AS mcc FROM top")
def a21(spark, folder):
    best = metrics.best_threshold(metrics.threshold_sweep(fold_scores(spark, folder), by=["fold"]), ["fold"])
    return round_columns(best, ["threshold", "f1", "mcc"])


@query("c15_evaluate_with_guard", f"WITH {EVAL_SQL.replace('ev AS (SELECT fold, label,', 'ev AS (SELECT fold, CASE WHEN fold = 3 THEN 0 WHEN fold = 2 THEN 1 ELSE label END AS label,')} {EVALUATE_SQL}")
def c15(spark, folder):
    one_class = fold_scores(spark, folder).withColumn("label", F.when(F.col("fold") == 3, 0).when(F.col("fold") == 2, 1).otherwise(F.col("label")))
    return round_columns(metrics.evaluate(one_class, by=["fold"]), ["auc_pr", "auc_roc", "threshold", "f1", "mcc"])


@query(
    "a17_fold_summary",
    f"WITH {EVAL_SQL} SELECT {R('avg(auc_pr)')} AS mean_auc_pr, {R('stddev_pop(auc_pr)')} AS std_auc_pr, "
    f"{R('avg(auc_roc)')} AS mean_auc_roc, {R('stddev_pop(auc_roc)')} AS std_auc_roc FROM aucs",
)
def a17(spark, folder):
    scores = fold_scores(spark, folder)
    both = metrics.auc_pr(scores, by=["fold"]).join(metrics.auc_roc(scores, by=["fold"]), "fold")
    out = metrics.fold_summary(both, ["auc_pr", "auc_roc"])
    return round_columns(out, out.columns)


@query(
    "a18_quality_auc_pr",
    f"""WITH ev AS (SELECT toxic AS fold, quality AS label, {R('n_chars / 20000.0::DOUBLE', 3)} AS score FROM labels JOIN documents USING (doc_id)),
    {METRICS_SQL} SELECT CAST(fold AS BIGINT) AS fold, {R('auc_pr')} AS auc_pr, {R('auc_roc')} AS auc_roc FROM aucs""",
)
def a18_quality(spark, folder):
    scored = fx.table(spark, folder, "labels").join(fx.table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    scored = scored.select(F.col("toxic").cast("bigint").alias("fold"), F.col("quality").alias("label"), F.round(F.col("n_chars") / 20000.0, 3).alias("score"))
    both = metrics.auc_pr(scored, by=["fold"]).join(metrics.auc_roc(scored, by=["fold"]), "fold")
    return round_columns(both, ["auc_pr", "auc_roc"])


@query(
    "a22_pu_bce",
    f"""WITH {fx.SCORED_SQL} SELECT {R('avg((CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) * (greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))))')} AS loss
    FROM (SELECT label, (score - 0.5) * 8 AS x FROM scored)""",
)
def a22(spark, folder):
    weight = F.when(F.col("label") == 1, 1.0).otherwise(0.1)
    logit = (F.col("score") - 0.5) * 8
    return fx.scored(spark, folder).agg(rounded(metrics.pu_bce(F.col("label"), logit, weight)).alias("loss"))


@query(
    "w4_average_rank",
    f"""WITH {fx.CELLS_SQL}, n AS (SELECT b0, b3 AS value, count(*) AS ties FROM cells WHERE b3 IS NOT NULL GROUP BY ALL)
    SELECT b0, value, ties, {R('sum(ties) OVER (PARTITION BY b0 ORDER BY value) - ties + (ties + 1) / 2.0::DOUBLE')} AS rank FROM n""",
)
def w4(spark, folder):
    return round_columns(metrics.average_rank(fx.stored_cells(spark, folder), "b3", ["b0"]), ["rank"])


# ---- radiometric statistics ----------------------------------------------

_RULES = {"MACHINERY": "Gold (vein)", "BUILDING": " iron ore", "AUTOMOBILE": "Chromite", "HOUSEHOLD": "copper-zinc"}
_RAW = "CASE segment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RULES.items()) + " END"


def typed_points(spark, folder):
    """Points with the deposit type of their segment's text.

    The text is looked up by row. Were it chosen by CASE, the optimizer would lower the constant texts on the driver, where
    the case tables that Spark then loads for all characters leave some GB of garbage.
    """
    grid = fx.cell_grid(spark, folder)
    texts = F.create_map(*[F.lit(x) for rule in _RULES.items() for x in rule])
    return fx.points(spark, folder, grid).withColumn("dep_type", categories.deposit_type(texts[F.col("segment")]))


TYPES_SQL = f"""typed AS (
  SELECT *, CASE segment WHEN 'MACHINERY' THEN 'gold' WHEN 'BUILDING' THEN 'iron' WHEN 'AUTOMOBILE' THEN 'chromite'
            WHEN 'HOUSEHOLD' THEN 'polymetallic' ELSE 'unknown' END AS dep_type FROM points)"""

SAMPLED_SQL = f"""{fx.CELLS_SQL}, {fx.POINTS_SQL}, {TYPES_SQL},
  located AS (SELECT t.*, CAST(floor(x / 50) AS BIGINT) AS col, CAST(floor((h * 50.0::DOUBLE - y) / 50) AS BIGINT) AS row FROM typed t, dim),
  sampled AS (
    SELECT l.id, any_value(l.dep_type) AS dep_type, median(c.b2) AS k, median(c.b3) AS u, median(c.b4) AS th
    FROM located l LEFT JOIN cells c ON abs(c.row - l.row) <= 2 AND abs(c.col - l.col) <= 2 GROUP BY l.id)"""


def sampled_points(spark, folder):
    grid = fx.cell_grid(spark, folder)
    base = fx.stored_cells(spark, folder).select("row", "col", F.col("b2").alias("k"), F.col("b3").alias("u"), F.col("b4").alias("th"))
    return points.point_window_median(typed_points(spark, folder), base, ["k", "u", "th"], grid)


def stored_samples(spark, folder):
    """The sampled values written once, as the statistics read them several times."""
    return stored(sampled_points(spark, folder), "samples")


@query(
    "c12_categorise_type",
    f"WITH {fx.CELLS_SQL}, {fx.POINTS_SQL}, {TYPES_SQL} SELECT id, dep_type FROM typed",
)
def c12(spark, folder):
    return typed_points(spark, folder).select("id", "dep_type")


@query(
    "c12_categorise_parts",
    """SELECT p_partkey, CASE WHEN t LIKE '%gold%' THEN 'gold' WHEN t LIKE '%iron%' OR t LIKE '%fe%' THEN 'iron' WHEN t LIKE '%chrom%' THEN 'chromite'
       WHEN regexp_matches(t, 'poly|copper|cu|zinc|zn|lead|pb|silver|ag') THEN 'polymetallic' ELSE 'unknown' END AS dep_type
       FROM (SELECT p_partkey, lower(trim(p_name || ' ' || p_type)) AS t FROM part)""",
)
def c12_parts(spark, folder):
    text = F.concat_ws(" ", "p_name", "p_type")
    return fx.table(spark, folder, "part").select("p_partkey", categories.deposit_type(text).alias("dep_type"))


@query("a7_value_counts", f"WITH {fx.CELLS_SQL}, {fx.POINTS_SQL}, {TYPES_SQL} SELECT dep_type, count(*) AS n FROM typed GROUP BY dep_type")
def a7(spark, folder):
    return typed_points(spark, folder).groupBy("dep_type").agg(F.count("*").alias("n"))


@query(
    "j2_point_window_median",
    f"WITH {SAMPLED_SQL} SELECT id, dep_type, {R('k')} AS k, {R('u')} AS u, {R('th')} AS th FROM sampled",
)
def j2(spark, folder):
    return round_columns(sampled_points(spark, folder).select("id", "dep_type", "k", "u", "th"), ["k", "u", "th"])


@query(
    "a6_group_channel_stats",
    f"""WITH {SAMPLED_SQL}, l AS (SELECT dep_type, channel, value FROM sampled UNPIVOT (value FOR channel IN (k, u, th)))
    SELECT dep_type, channel, count(*) AS n, {R('avg(value)')} AS mean, {R('median(value)')} AS median, {R('stddev_pop(value)')} AS std,
           {R('quantile_cont(value, 0.25)')} AS q25, {R('quantile_cont(value, 0.75)')} AS q75
    FROM l WHERE dep_type <> 'unknown' GROUP BY dep_type, channel""",
)
def a6(spark, folder):
    out = metrics.group_channel_stats(stored_samples(spark, folder), "dep_type", ["k", "u", "th"], categories.DEPOSIT_ORDER)
    return round_columns(out.drop("ord"), ["mean", "median", "std", "q25", "q75"])


@query(
    "a28_kruskal_wallis",
    f"""WITH {SAMPLED_SQL}, by_segment AS (SELECT s.*, p.segment FROM sampled s JOIN points p USING (id)),
    l AS (SELECT segment, channel, value FROM by_segment UNPIVOT (value FOR channel IN (k, u, th))),
    ranked AS (SELECT *, rank() OVER (PARTITION BY channel ORDER BY value) + (count(*) OVER (PARTITION BY channel, value) - 1) / 2.0::DOUBLE AS r,
               count(*) OVER (PARTITION BY channel, value) AS t FROM l),
    g AS (SELECT channel, segment, sum(r) AS r, count(*) AS n FROM ranked GROUP BY channel, segment),
    tie AS (SELECT channel, sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM ranked GROUP BY channel),
    s AS (SELECT channel, sum(r * r / n) AS s, CAST(sum(n) AS DOUBLE) AS n, count(*) AS k FROM g GROUP BY channel),
    h AS (SELECT s.channel, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h, k - 1 AS df FROM s JOIN tie ON s.channel = tie.channel)
    SELECT channel, {R('h')} AS h, df, {R('exp(-h / 2) * (1 + h / 2)')} AS p, exp(-h / 2) * (1 + h / 2) < 0.05 AS significant FROM h""",
)
def a28(spark, folder):
    long = stored_samples(spark, folder).select("segment", "k", "u", "th").unpivot(["segment"], ["k", "u", "th"], "channel", "value")
    return round_columns(metrics.kruskal_wallis(long, "segment", "channel", "value"), ["h", "p"])


def _cross(a: str, b: str) -> str:
    """Cross product of two lists of three."""
    return "[" + ", ".join(f"{a}[{i}] * {b}[{j}] - {a}[{j}] * {b}[{i}]" for i, j in ((2, 3), (3, 1), (1, 2))) + "]"


#: Components of three columns in closed form: the cubic of their correlations has its roots by an angle, and a component is
#: at right angles to the rows of what is left of the matrix; of the three pairs of rows, the one that tells most.
PCA_SQL = f"""{SAMPLED_SQL}, known AS (SELECT * FROM sampled WHERE k IS NOT NULL AND u IS NOT NULL AND th IS NOT NULL),
    moments AS (SELECT avg(k) AS mk, avg(u) AS mu, avg(th) AS mt, stddev_pop(k) AS sk, stddev_pop(u) AS su, stddev_pop(th) AS st,
        corr(k, u) AS ku, corr(k, th) AS kt, corr(u, th) AS ut FROM known),
    spread AS (SELECT *, sqrt((ku * ku + kt * kt + ut * ut) / 3) AS p FROM moments),
    angle AS (SELECT *, acos(greatest(least(ku * kt * ut / (p * p * p), 1.0::DOUBLE), -1.0::DOUBLE)) / 3 AS phi FROM spread),
    roots AS (SELECT *, unnest([1, 2]) AS component, 1 + 2 * p * cos(phi) AS e1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM angle),
    eigen AS (SELECT *, CASE component WHEN 1 THEN e1 ELSE 3 - e1 - e3 END AS e FROM roots),
    rest AS (SELECT *, [1 - e, ku, kt] AS r1, [ku, 1 - e, ut] AS r2, [kt, ut, 1 - e] AS r3 FROM eigen),
    normals AS (SELECT component, e, unnest([{_cross("r1", "r2")}, {_cross("r1", "r3")}, {_cross("r2", "r3")}]) AS v FROM rest),
    longest AS (SELECT component, any_value(e) AS e, max_by(v, list_dot_product(v, v)) AS v FROM normals GROUP BY component),
    signed AS (SELECT component, e, v, sqrt(list_dot_product(v, v)) * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END AS size FROM longest),
    loadings AS (SELECT component, e / 3 AS ratio, list_transform(v, lambda x: x / size) AS w FROM signed)"""


@query(
    "a29_pca2",
    f"""WITH {PCA_SQL}, z AS (SELECT id, dep_type, k, u, th, [(k - mk) / sk, (u - mu) / su, (th - mt) / st] AS z FROM known, moments)
    SELECT id, dep_type, {R('k')} AS k, {R('u')} AS u, {R('th')} AS th, {R('list_dot_product(z, a.w)')} AS pc1, {R('list_dot_product(z, b.w)')} AS pc2
    FROM z, loadings a, loadings b WHERE a.component = 1 AND b.component = 2""",
)
def a29(spark, folder):
    base = stored_samples(spark, folder)
    fitted = metrics.principal_components(base, ["k", "u", "th"])
    scores = metrics.project_components(base.select("id", "dep_type", "k", "u", "th"), fitted)
    return round_columns(scores, ["k", "u", "th", "pc1", "pc2"])


@query(
    "a29_loadings",
    f"""WITH {PCA_SQL} SELECT component, channel, {R('ratio')} AS ratio, {R('w[i]')} AS loading
    FROM loadings, (VALUES (1, 'k'), (2, 'u'), (3, 'th')) AS c(i, channel)""",
)
def a29_loadings(spark, folder):
    """Share of the variance and loadings of both components."""
    channels = ["k", "u", "th"]
    fitted = metrics.principal_components(stored_samples(spark, folder), channels)
    rows = [
        (i, c, ratio, w)
        for i, (ratio, loading) in enumerate(zip(fitted["ratio"], fitted["loadings"]), start=1)
        for c, w in zip(channels, loading)
    ]
    return round_columns(spark.createDataFrame(rows, "component int, channel string, ratio double, loading double"), ["ratio", "loading"])


@query(
    "c18_ternary_projection",
    f"""WITH {SAMPLED_SQL}, m AS (SELECT min(k) AS k0, max(k) AS k1, min(u) AS u0, max(u) AS u1, min(th) AS t0, max(th) AS t1 FROM sampled),
    n AS (SELECT id, dep_type, (k - k0) / (k1 - k0 + 1e-9) AS a, (u - u0) / (u1 - u0 + 1e-9) AS b, (th - t0) / (t1 - t0 + 1e-9) AS c FROM sampled, m
      WHERE dep_type <> 'unknown' AND k IS NOT NULL AND u IS NOT NULL AND th IS NOT NULL)
    SELECT id, dep_type, {R('CASE WHEN a + b + c <> 0 THEN b / (a + b + c) + c / (a + b + c) / 2 END')} AS x,
           {R('CASE WHEN a + b + c <> 0 THEN c / (a + b + c) * sqrt(3.0::DOUBLE) / 2 END')} AS y FROM n""",
)
def c18(spark, folder):
    out = metrics.ternary_projection(stored_samples(spark, folder), "dep_type", ["k", "u", "th"], categories.DEPOSIT_ORDER)
    return round_columns(out.select("id", "dep_type", "x", "y"), ["x", "y"])


# ---- curves and tiers ----------------------------------------------------

OCC_SQL = f"""{fx.SCORED_SQL}, {fx.POINTS_SQL},
  occ AS (
    SELECT p.id, s.row, s.col, s.score FROM points p, dim, scored s
    WHERE s.row = CAST(floor((h * 50.0::DOUBLE - y) / 50) AS BIGINT) AND s.col = CAST(floor(x / 50) AS BIGINT))"""


def occurrence_scores(spark, folder):
    grid = fx.cell_grid(spark, folder)
    return points.occurrence_scores(fx.points(spark, folder, grid).select("id", "x", "y"), fx.scored(spark, folder), "score", grid)


@query("j9_occurrence_scores", f"WITH {OCC_SQL} SELECT id, row, col, score FROM occ")
def j9(spark, folder):
    return occurrence_scores(spark, folder).select("id", "row", "col", "score")


CURVE_SQL = f"""{OCC_SQL},
  probs AS (SELECT i AS step, CASE WHEN i = 199 THEN 0.0::DOUBLE ELSE (100.0::DOUBLE + i * (-100.0::DOUBLE / 199)) / 100 END AS p FROM (SELECT unnest(range(0, 200)) AS i)),
  ordered AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM scored),
  cuts AS (
    SELECT step, max(CASE WHEN k = floor(p * (n - 1)) THEN score END) AS lo, max(CASE WHEN k = ceil(p * (n - 1)) THEN score END) AS hi, any_value(p * (n - 1)) AS pos
    FROM probs, ordered WHERE k BETWEEN floor(p * (n - 1)) AND ceil(p * (n - 1)) GROUP BY step),
  thresholds AS (SELECT step, CASE WHEN lo = hi THEN lo ELSE lo * (ceil(pos) - pos) + hi * (pos - floor(pos)) END AS threshold FROM cuts),
  curve AS (
    SELECT step, threshold, 100.0::DOUBLE * (SELECT count(*) FROM scored s WHERE s.score >= threshold) / (SELECT count(*) FROM scored) AS pct_area,
           100.0::DOUBLE * (SELECT count(*) FROM occ o WHERE o.score >= threshold) / (SELECT count(*) FROM occ) AS pct_occ
    FROM thresholds)"""


@query(
    "a30_success_rate_curve",
    f"WITH {CURVE_SQL} SELECT step, {R('threshold')} AS threshold, {R('pct_area')} AS pct_area, {R('pct_occ')} AS pct_occ FROM curve",
)
def a30(spark, folder):
    curve = metrics.success_rate_curve(fx.scored(spark, folder), occurrence_scores(spark, folder))
    return round_columns(curve, ["threshold", "pct_area", "pct_occ"])


#: Curves per customer segment: running share of points against running share of balance.
KNOTS_SQL = """
  knots AS (
    SELECT c_mktsegment AS segment, CAST(floor((c_acctbal + 1000) / 500) AS BIGINT) * 4.0::DOUBLE AS x, CAST(count(*) AS DOUBLE) AS y FROM customer GROUP BY 1, 2),
  rising AS (SELECT segment, x, sum(y) OVER (PARTITION BY segment ORDER BY x) AS y FROM knots)"""


@query(
    "j10_interp_join",
    f"""WITH {KNOTS_SQL}, asked AS (SELECT DISTINCT segment, i AS step, CASE WHEN i = 199 THEN 100.0::DOUBLE ELSE i * (100.0::DOUBLE / 199) END AS x FROM knots, (SELECT unnest(range(0, 200)) AS i)),
    b AS (SELECT a.segment, a.step, a.x, (SELECT max_by(struct_pack(x := k.x, y := k.y), k.x) FROM rising k WHERE k.segment = a.segment AND k.x <= a.x) AS lo,
                 (SELECT min_by(struct_pack(x := k.x, y := k.y), k.x) FROM rising k WHERE k.segment = a.segment AND k.x >= a.x) AS hi FROM asked a)
    SELECT segment, step, {R('x')} AS x, {R('CASE WHEN lo IS NULL THEN hi.y WHEN hi IS NULL OR hi.x = lo.x THEN lo.y ELSE lo.y + (hi.y - lo.y) * (x - lo.x) / (hi.x - lo.x) END')} AS y FROM b""",
)
def j10(spark, folder):
    from cellweave.scale import running_totals

    bins = (F.floor((F.col("c_acctbal") + 1000) / 500) * 4.0).alias("x")
    counts = fx.table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("segment"), bins).agg(F.count("*").cast("double").alias("n"))
    curve = running_totals(counts, "x", ["n"], ["segment"])
    return round_columns(metrics.interpolate_curves(curve, "segment", "x", "cum_n"), ["x", "y"])


PU_SQL = f"""{fx.PASSES_SQL},
  pu AS (SELECT row, col, avg(prob) AS mean, stddev_samp(prob) AS std FROM passes GROUP BY row, col)"""


@query("a16_mc_mean_std", f"WITH {PU_SQL} SELECT row, col, {R('mean')} AS mean, {R('std')} AS std FROM pu")
def a16(spark, folder):
    return round_columns(mc_mean_std(fx.passes(spark, folder), ["row", "col"]), ["mean", "std"])


TIER_SQL = f"""{PU_SQL}, pr AS (SELECT row, col, {R('mean')} AS p, {R('std')} AS u FROM pu),
  bound AS (SELECT coalesce(median(u), 0.02) AS b FROM pr WHERE p > 0.25),
  tiers AS (SELECT row, col, CASE WHEN p > 0.25 AND u <= b THEN 1 WHEN p > 0.25 AND u > b THEN 2 WHEN p <= 0.10 AND u <= b THEN 3 WHEN p <= 0.10 AND u > b THEN 4 END AS tier FROM pr, bound)"""


def tiers(spark, folder):
    pu = mc_mean_std(fx.passes(spark, folder), ["row", "col"]).select("row", "col", rounded("mean").alias("p"), rounded("std").alias("u"))
    pu = stored(pu, "maps")
    return metrics.exploration_tiers(pu, "p", "u")


@query("c17_exploration_tiers", f"WITH {TIER_SQL} SELECT row, col, tier FROM tiers")
def c17(spark, folder):
    return tiers(spark, folder).select("row", "col", "tier")


@query("a31_tier_area", f"WITH {TIER_SQL} SELECT tier, count(*) AS n, {R('count(*) * 0.0025')} AS area_km2 FROM tiers WHERE tier IS NOT NULL GROUP BY tier")
def a31(spark, folder):
    return round_columns(metrics.tier_area(tiers(spark, folder)), ["area_km2"])


@query("c16_clip_unit", f"WITH {fx.PASSES_SQL} SELECT row, col, pass, {R('least(1.0::DOUBLE, greatest(0.0::DOUBLE, prob))')} AS prob FROM passes")
def c16(spark, folder):
    from cellweave.functions.scalars import clip

    return fx.passes(spark, folder).select("row", "col", F.col("pass").cast("bigint").alias("pass"), rounded(clip(F.col("prob"), 0.0, 1.0)).alias("prob"))


@query("f1_sigmoid_clipped", f"WITH {fx.CELLS_SQL} SELECT row, col, {R('1 / (1 + exp(-least(30.0::DOUBLE, greatest(-30.0::DOUBLE, b5 / 100))))')} AS p FROM cells")
def f1(spark, folder):
    return fx.cells(spark, folder).select("row", "col", rounded(sigmoid_clipped(F.col("b5") / 100)).alias("p"))


@query(
    "f2_linspace",
    f"SELECT r_regionkey, i AS step, {R('0.01::DOUBLE + i * (0.98::DOUBLE / 49)')} AS threshold FROM region, (SELECT unnest(range(0, 50)) AS i)",
)
def f2(spark, folder):
    base = fx.table(spark, folder, "region").select("r_regionkey", F.posexplode(linspace(0.01, 0.99, 50)).alias("step", "threshold"))
    return base.select("r_regionkey", F.col("step").cast("bigint").alias("step"), rounded("threshold").alias("threshold"))


# ---- run logs ------------------------------------------------------------


@query("a34_best_epoch", f"WITH {fx.RUNS_SQL} SELECT run, arg_max(epoch, struct_pack(m := auc_pr, e := -epoch)) AS best_epoch, max(auc_pr) AS best_metric, count(*) AS n_epochs FROM run_log GROUP BY run")
def a34(spark, folder):
    return runs.best_epoch(fx.run_log(spark, folder), ["run"])


@query(
    "a34_early_stop",
    f"""WITH RECURSIVE {fx.RUNS_SQL},
    n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM run_log),
    walk AS (
      SELECT run, k, CASE WHEN auc_pr > 0.01 THEN auc_pr ELSE 0.0 END AS best, CASE WHEN auc_pr > 0.01 THEN epoch END AS at_epoch,
             CASE WHEN auc_pr > 0.01 THEN 0 ELSE 1 END AS waited, CAST(NULL AS BIGINT) AS stopped FROM n WHERE k = 1
      UNION ALL
      SELECT w.run, n.k, CASE WHEN n.auc_pr > w.best + 0.01 THEN n.auc_pr ELSE w.best END, CASE WHEN n.auc_pr > w.best + 0.01 THEN n.epoch ELSE w.at_epoch END,
             CASE WHEN n.auc_pr > w.best + 0.01 THEN 0 ELSE w.waited + 1 END,
             CASE WHEN n.auc_pr <= w.best + 0.01 AND w.waited + 1 >= 4 AND n.epoch > 5 THEN n.epoch END
      FROM walk w JOIN n ON n.run = w.run AND n.k = w.k + 1 WHERE w.stopped IS NULL)
    SELECT run, arg_max(best, k) AS best_metric, max_by(at_epoch, k) AS best_epoch, max(stopped) AS stop_epoch FROM walk GROUP BY run""",
)
def a34_stop(spark, folder):
    return runs.reduce_logs(fx.run_log(spark, folder), ["run"], "auc_pr", min_delta=0.01, patience=4, freeze_epochs=5)


@query(
    "a35_ablation_drop",
    f"""WITH {fx.RUNS_SQL}, r AS (SELECT run % 30 AS fold, CASE run // 30 WHEN 0 THEN 'full' WHEN 1 THEN 'no_cca' WHEN 2 THEN 'geo' ELSE 'aero' END AS variant, max(auc_pr) AS auc_pr
      FROM run_log GROUP BY 1, 2)
    SELECT r.fold, r.variant, r.auc_pr, {R('f.auc_pr - r.auc_pr')} AS "drop" FROM r JOIN r f ON f.fold = r.fold AND f.variant = 'full'""",
)
def a35(spark, folder):
    variant = F.expr("CASE run div 30 WHEN 0 THEN 'full' WHEN 1 THEN 'no_cca' WHEN 2 THEN 'geo' ELSE 'aero' END")
    results = fx.run_log(spark, folder).groupBy((F.col("run") % 30).alias("fold"), variant.alias("variant")).agg(F.max("auc_pr").alias("auc_pr"))
    return round_columns(runs.ablation_drop(results, "auc_pr"), ["drop"])


@query("a36_distinct_categories", "SELECT DISTINCT p_type AS category, dense_rank() OVER (ORDER BY p_type) AS code FROM part")
def a36(spark, folder):
    from cellweave.operators.geometry import category_codes

    return category_codes(fx.table(spark, folder, "part"), "p_type")
