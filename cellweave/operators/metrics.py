"""Ranking metrics, threshold sweeps, rank tests and curves.

Every metric first folds the rows to one per distinct score (or score class), so a hot
score is one row, and then works on running totals that are distributed when large.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.scalars import guarded_ratio, linear_bucket, linspace_values
from cellweave.scale import exact_percentiles, percentile_values, running_totals, small_side
from cellweave.session import checkpointed


def score_counts(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """`by..., score, pos, neg`: one row per distinct score."""
    positive = (F.col(label) == 1).cast("bigint")
    return (
        scored.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )


def ranking(counts: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """`by..., auc_pr, auc_roc` from score counts, both out of one descending running total.

    auc_pr is the average precision over distinct scores without interpolation; auc_roc the
    probability that a positive outranks a negative, ties counting one half.  Both are 0 when
    a class is missing.
    """
    running = running_totals(counts, "score", ["pos", "neg"], by, descending=True, **options)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    outranked_by = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    totals = running.groupBy(*by).agg(
        F.sum(F.col("pos") * precision).alias("_s"),
        F.sum(outranked_by).alias("_lost"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum("neg").cast("double").alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return totals.select(
        *by,
        F.when(both, F.col("_s") / F.col("_p")).otherwise(0.0).alias("auc_pr"),
        F.when(both, 1 - F.col("_lost") / (F.col("_p") * F.col("_n"))).otherwise(0.0).alias("auc_roc"),
    )


def auc_pr(scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), **options) -> DataFrame:
    """Average precision per group."""
    return ranking(score_counts(scored, label, score, by), by, **options).select(*by, "auc_pr")


def auc_roc(scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), **options) -> DataFrame:
    """Area under the receiver operating curve per group."""
    return ranking(score_counts(scored, label, score, by), by, **options).select(*by, "auc_roc")


def threshold_sweep(
    scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
    start: float = 0.01, stop: float = 0.99, n: int = 50,
) -> DataFrame:
    """`by..., step, threshold, tp, fp, fn, tn, f1, mcc`; thresholds nothing reaches are left out."""
    return sweep_counts(score_counts(scored, label, score, by), by, start, stop, n)


def sweep_counts(counts: DataFrame, by: Sequence[str] = (), start: float = 0.01, stop: float = 0.99, n: int = 50) -> DataFrame:
    """`threshold_sweep` from score counts: at most n + 1 classes per group leave the scan."""
    thresholds = linspace_values(start, stop, n)
    classes = counts.groupBy(*by, linear_bucket(F.col("score"), start, stop, n).alias("score")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    whole = Window.partitionBy(*by)
    reach = whole.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    steps = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step")
    frame = classes.select(*by).distinct().select(*by, steps) if by else classes.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("step"))
    keyed = classes.withColumnRenamed("score", "step").withColumn("step", F.col("step").cast("int"))
    filled = frame.join(keyed, [*by, "step"], "left").na.fill(0, ["pos", "neg"])
    table = F.array(*[F.lit(t) for t in thresholds])
    counted = filled.select(
        *by,
        "step",
        F.sum("pos").over(reach).alias("tp"),
        F.sum("neg").over(reach).alias("fp"),
        F.sum("pos").over(whole).alias("_p"),
        F.sum("neg").over(whole).alias("_n"),
    ).where((F.col("step") > 0) & (F.col("tp") + F.col("fp") > 0))
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    fn, tn = F.col("_p") - tp, F.col("_n") - fp
    f1 = guarded_ratio(2 * tp, 2 * tp + fp + fn)
    mcc = guarded_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counted.select(
        *by,
        (F.col("step") - 1).alias("step"),
        F.get(table, F.col("step") - 1).alias("threshold"),
        "tp",
        "fp",
        fn.cast("bigint").alias("fn"),
        tn.cast("bigint").alias("tn"),
        f1.alias("f1"),
        mcc.alias("mcc"),
    )


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest F1 above 0, the lowest threshold on ties; else threshold 0.5 with zeros."""
    best = sweep.groupBy(*by).agg(F.max(F.struct(F.col("f1"), (-F.col("step")).alias("k"), "threshold", "mcc")).alias("_b"))
    some = F.col("_b.f1") > 0
    return best.select(
        *by,
        F.when(some, F.col("_b.threshold")).otherwise(0.5).alias("threshold"),
        F.when(some, F.col("_b.f1")).otherwise(0.0).alias("f1"),
        F.when(some, F.col("_b.mcc")).otherwise(0.0).alias("mcc"),
    )


def evaluate(scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), **options) -> DataFrame:
    """auc_pr, auc_roc, best threshold, f1 and mcc per group; zeros when a class is missing.

    All of them come from the counts per distinct score, which are computed once.
    """
    by = list(by)
    counts = checkpointed(score_counts(scored, label, score, by))
    ranks = ranking(counts, by, **options)
    both = counts.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).where("_p > 0 AND _n > 0").drop("_p", "_n")
    if not by and both.isEmpty():
        counts = counts.where(F.lit(False))
    swept = sweep_counts(counts.join(both, by, "left_semi") if by else counts, by)
    best = best_threshold(swept, by)
    if by:
        return ranks.join(best, by, "left").na.fill({"threshold": 0.5, "f1": 0.0, "mcc": 0.0})
    row = {**ranks.first().asDict(), **best.first().asDict()}
    return scored.sparkSession.createDataFrame([tuple(float(v or 0.0) for v in row.values())], ", ".join(f"{k} double" for k in row))


def pu_bce(label: Column, logit: Column, weight: Column) -> Column:
    """Mean weighted logistic loss (aggregate expression), stable for large logits."""
    loss = F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
    return F.avg(weight * loss)


def fold_summary(metrics: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of metrics across folds."""
    return metrics.groupBy(*by).agg(
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), **options) -> DataFrame:
    """`by..., value, ties, rank`: tie-averaged 1-based rank of each distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("ties"))
    running = running_totals(counts, "value", ["ties"], by, **options)
    return running.select(*by, "value", "ties", (F.col("cum_ties") - F.col("ties") + (F.col("ties") + 1) / 2).alias("rank"))


@F.pandas_udf(T.DoubleType())
def _chi2_upper(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution for whole degrees of freedom (closed form)."""

    def tail(x: float, k: int) -> float:
        if not x > 0:
            return 1.0
        half = x / 2
        if k % 2 == 0:
            term = total = 1.0
            for i in range(1, k // 2):
                term *= half / i
                total += term
            return math.exp(-half) * total
        total, term = 0.0, math.sqrt(half) / math.gamma(1.5)
        for i in range(1, (k - 1) // 2 + 1):
            total += term
            term *= half / (i + 0.5)
        return math.erfc(math.sqrt(half)) + math.exp(-half) * total

    return pd.Series([tail(float(x), int(k)) for x, k in zip(statistic, freedom)])


def kruskal_wallis(samples: DataFrame, group: str, channel: str, value: str, **options) -> DataFrame:
    """`channel, h, df, p, significant` with the tie correction.

    Groups of three or more values take part; a channel needs two of them.  Ranks are found
    per distinct value, and the p-value function sees one row per channel.
    """
    known = samples.where(F.col(value).isNotNull())
    sizes = small_side(known.groupBy(channel, group).agg(F.count("*").alias("_size")).where(F.col("_size") > 2))
    used = known.join(sizes.select(channel, group), [channel, group])
    per_group = used.groupBy(channel, group, F.col(value).alias("value")).agg(F.count("*").alias("m"))
    ranks = average_rank(used, value, [channel], **options)
    sums = (
        per_group.join(ranks, [channel, "value"])
        .groupBy(channel, group)
        .agg(F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum("m").alias("n"))
    )
    shape = sums.groupBy(channel).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    t = F.col("ties").cast("double")
    ties = ranks.groupBy(channel).agg(F.sum(t * t * t - t).alias("tie"))
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    correction = 1 - F.col("tie") / (n * n * n - n)
    tested = (
        shape.join(ties, channel)
        .where((F.col("k") >= 2) & (correction > 0))
        .select(channel, (raw / correction).alias("h"), (F.col("k") - 1).alias("df"))
    )
    p = _chi2_upper("h", "df")
    return tested.withColumn("p", p).withColumn("significant", F.col("p") < 0.05)


def group_channel_stats(samples: DataFrame, group: str, channels: Sequence[str], order: Sequence[str], **options) -> DataFrame:
    """n, mean, median, population std and quartiles per listed group and channel."""
    long = (
        samples.where(F.col(group).isin(list(order)))
        .select(group, *[F.col(c).cast("double").alias(c) for c in channels])
        .unpivot([group], list(channels), "channel", "value")
        .where(F.col("value").isNotNull())
    )
    moments = long.groupBy(group, "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    quartiles = exact_percentiles(long, "value", [0.25, 0.5, 0.75], [group, "channel"], **options)
    position = F.array_position(F.array(*[F.lit(g) for g in order]), F.col(group))
    return moments.join(quartiles, [group, "channel"]).select(
        position.alias("ord"),
        group,
        "channel",
        "n",
        "mean",
        F.get("pct", F.lit(1)).alias("median"),
        "std",
        F.get("pct", F.lit(0)).alias("q25"),
        F.get("pct", F.lit(2)).alias("q75"),
    )


def principal_components(samples: DataFrame, columns: Sequence[str], components: int = 2, minimum: int = 10) -> dict | None:
    """Standardised principal components of a few columns: loadings, ratios, mean and scale.

    One pass gathers the (columns x columns) moments; that small matrix is decomposed on the
    driver.  The sign makes the largest loading positive.  None below `minimum` rows.
    """
    known = samples.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = known.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    if row["n"] < minimum:
        return None
    size = len(columns)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    top = np.argsort(values)[::-1][:components]
    loadings = vectors[:, top]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), range(len(top))])
    return {
        "columns": list(columns),
        "mean": [row[f"m{i}"] for i in range(size)],
        "scale": scale.tolist(),
        "loadings": loadings.T.tolist(),
        "ratio": (values[top] / values.sum()).tolist(),
    }


def project_components(samples: DataFrame, fitted: dict) -> DataFrame:
    """Add pc1, pc2, ... and drop rows with a missing column."""
    out = samples.where(" AND ".join(f"`{c}` IS NOT NULL" for c in fitted["columns"]))
    for k, loading in enumerate(fitted["loadings"], start=1):
        score = F.lit(0.0)
        for c, m, s, w in zip(fitted["columns"], fitted["mean"], fitted["scale"], loading):
            score = score + (F.col(c) - m) / s * w
        out = out.withColumn(f"pc{k}", score)
    return out


def ternary_projection(samples: DataFrame, group: str, channels: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `x, y`: min-max scaled three-part composition on the unit triangle.

    The ranges come from all rows; only listed groups with all three channels are placed.
    """
    ranges = samples.agg(*[f(c).alias(f"{n}_{c}") for c in channels for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for c in channels:
        low, high = ranges[f"lo_{c}"], ranges[f"hi_{c}"]
        scaled[c] = (F.col(c) - low) / (high - low + 1e-9) if low is not None else F.lit(None).cast("double")
    a, b, c = (scaled[name] for name in channels)
    total = a + b + c
    share_b, share_c = F.when(total != 0, b / total), F.when(total != 0, c / total)
    present = samples.where(F.col(group).isin(list(order))).where(" AND ".join(f"`{n}` IS NOT NULL" for n in channels))
    return present.withColumn("x", share_b + share_c / 2).withColumn("y", share_c * math.sqrt(3) / 2)


def _reach(values: DataFrame, column: str, thresholds: Sequence[float]) -> dict[float, int]:
    """How many values are >= each threshold; one scan with a JVM binary search per row."""
    from pyspark.ml.feature import Bucketizer

    distinct = sorted(set(thresholds))
    splits = [-math.inf, *distinct, math.inf]
    clean = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    counted = Bucketizer(splits=splits, inputCol="_v", outputCol="_k").transform(clean).groupBy("_k").count().collect()
    per_class = {int(r["_k"]): r["count"] for r in counted}  # at most len(thresholds) + 1 rows
    reach, total = {}, 0
    for k in range(len(distinct), 0, -1):
        total += per_class.get(k, 0)
        reach[distinct[k - 1]] = total
    return reach


def success_rate_curve(scores: DataFrame, occurrence_scores: DataFrame, score: str = "score", points: int = 200, **options) -> DataFrame:
    """`step, threshold, pct_area, pct_occ` for `points` percentile thresholds, high to low.

    `scores` are the valid cells, `occurrence_scores` the cells under the known points.
    """
    spark = scores.sparkSession
    schema = "step bigint, threshold double, pct_area double, pct_occ double"
    probs = [p / 100 for p in linspace_values(100.0, 0.0, points)]
    thresholds = percentile_values(scores, score, probs, **options)
    n_occ = occurrence_scores.where(F.col(score).isNotNull()).count()
    if thresholds is None or n_occ == 0:
        return spark.createDataFrame([], schema)
    area, occ = _reach(scores, score, thresholds), _reach(occurrence_scores, score, thresholds)
    n_area = area[min(thresholds)]
    rows = [
        (i, t, 100.0 * area[t] / n_area, 100.0 * occ[t] / n_occ) for i, t in enumerate(thresholds)
    ]
    return spark.createDataFrame(rows, schema)


def interpolate_curves(curves: DataFrame, group: str, x: str, y: str, start: float = 0.0, stop: float = 100.0, n: int = 200) -> DataFrame:
    """`group, step, x, y`: each curve at common abscissae, linear between knots, flat outside.

    Knots and abscissae are merged in one ordered window, so no pair is formed.  Curves rise
    with x; where several knots share one x, a piece ends at the lowest of them and the next
    one starts at the highest.
    """
    knots = curves.groupBy(F.col(group), F.col(x).alias("x")).agg(F.min(y).alias("y_end"), F.max(y).alias("y_start"))
    grid = F.array(*[F.lit(v) for v in linspace_values(start, stop, n)])
    none = F.lit(None).cast("double")
    asked = curves.select(group).distinct().select(group, F.posexplode(grid).alias("k", "x"))
    merged = asked.withColumn("y_end", none).withColumn("y_start", none).unionByName(knots.withColumn("k", F.lit(None).cast("int")))
    knot = F.when(F.col("k").isNull(), F.struct("x", "y_end", "y_start"))
    # Of a knot and an abscissa at the same x the knot comes first in both directions.
    before = Window.partitionBy(group).orderBy(F.asc("x"), F.asc_nulls_first("k")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(group).orderBy(F.desc("x"), F.asc_nulls_first("k")).rowsBetween(Window.unboundedPreceding, 0)
    framed = merged.select(
        group, "k", "x", F.last(knot, ignorenulls=True).over(before).alias("a"), F.last(knot, ignorenulls=True).over(after).alias("b")
    ).where(F.col("k").isNotNull())
    gap = F.col("b.x") - F.col("a.x")
    value = (
        F.when(F.col("a").isNull(), F.col("b.y_end"))
        .when(F.col("b").isNull() | (gap == 0), F.col("a.y_start"))
        .otherwise(F.col("a.y_start") + (F.col("b.y_end") - F.col("a.y_start")) * (F.col("x") - F.col("a.x")) / gap)
    )
    return framed.select(group, F.col("k").cast("bigint").alias("step"), "x", value.alias("y"))


def mean_curve(curves: DataFrame, group: str, x: str, y: str, **options) -> DataFrame:
    """Mean and population deviation of interpolated curves per abscissa."""
    return (
        interpolate_curves(curves, group, x, y, **options)
        .groupBy("step", "x")
        .agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))
    )


def exploration_tiers(scored: DataFrame, p: str, u: str, p_high: float = 0.25, p_low: float = 0.10, **options) -> DataFrame:
    """Add `tier`; the uncertainty bound is the median where the score is high, else 0.02."""
    from cellweave.functions.categories import decision_tier

    median = percentile_values(scored.where(F.col(p) > p_high), u, [0.5], **options)
    bound = F.lit(0.02 if median is None else median[0])
    return scored.withColumn("tier", decision_tier(F.col(p), F.col(u), bound, p_high, p_low))


def tier_area(tiers: DataFrame, cell_km2: float = 0.0025) -> DataFrame:
    return (
        tiers.where(F.col("tier").isNotNull())
        .groupBy("tier")
        .agg(F.count("*").alias("n"))
        .withColumn("area_km2", F.col("n") * cell_km2)
    )
