"""Weights of evidence over a wide cell table.

The weight of a band needs only how many positive and other cells fall between its
candidate thresholds.  One pass counts those classes for all bands; everything after it
works on a few rows per band, and the posterior is a per-row expression with the chosen
weights as constants.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalars import sigmoid, threshold_bucket
from cellweave.operators.normalize import unpivot_bands
from cellweave.scale import exact_percentiles

DECILES = [i / 10 for i in range(1, 10)]


def band_thresholds(cells: DataFrame, bands: Sequence[str], decimals: int | None = None, **options) -> dict[str, list[float]]:
    """Candidate thresholds: distinct deciles of the values above 0.

    A band with fewer than 100 such values is tried at its median only.
    """
    long = unpivot_bands(cells, bands, keys=())
    positive = {
        r["band"]: r for r in exact_percentiles(long.where(F.col("value") > 0), "value", DECILES, ["band"], **options).collect()
    }
    rich = {b for b, r in positive.items() if r["n"] >= 100}
    found = {b: list(positive[b]["pct"]) for b in rich}
    poor = [b for b in bands if b not in rich]
    if poor:
        medians = exact_percentiles(unpivot_bands(cells, poor, keys=()), "value", [0.5], ["band"], **options)
        found.update({r["band"]: list(r["pct"]) for r in medians.collect()})
    if decimals is not None:
        found = {b: [round(t, decimals) for t in ts] for b, ts in found.items()}
    return {b: sorted(set(found[b])) for b in bands if b in found}


def woe_contingency(cells: DataFrame, bands: Sequence[str], thresholds: dict[str, list[float]], label: str = "label") -> DataFrame:
    """Per band and threshold: n_total, n_dep, n_b, n_db, n_dnb, n_ndb, n_ndnb.

    Values are first put into threshold classes, so a row is counted once per band and not
    once per threshold.  Overlaps are floored at 0.5; thresholds that leave fewer than 10
    cells on a side are dropped, as are bands with under 10 positives or 100 others.
    """
    bands = [b for b in bands if thresholds.get(b)]
    classes = F.array(
        *[
            F.struct(
                F.lit(b).alias("band"),
                F.when(F.col(b).isNotNull(), threshold_bucket(F.col(b).cast("double"), thresholds[b])).alias("cls"),
            )
            for b in bands
        ]
    )
    of_cells = (
        cells.select(F.explode(classes).alias("_c"), (F.col(label) == 1).alias("_pos"))
        .where(F.col("_c.cls").isNotNull())
        .select("_c.band", "_c.cls", F.lit(1).alias("n"), F.col("_pos").cast("int").alias("pos"), F.lit(None).cast("double").alias("thr"))
    )
    # One row without cells per threshold: a class may be empty, its threshold still counts.
    edges = [(b, i + 1, 0, 0, float(t)) for b in bands for i, t in enumerate(thresholds[b])]
    of_edges = cells.sparkSession.createDataFrame(edges, "band string, cls int, n int, pos int, thr double")
    counted = (
        of_cells.unionByName(of_edges)
        .groupBy("band", "cls")
        .agg(F.sum("n").cast("double").alias("n"), F.sum("pos").cast("double").alias("pos"), F.max("thr").alias("thr"))
    )
    whole = Window.partitionBy("band")
    from_here = whole.orderBy(F.desc("cls")).rowsBetween(Window.unboundedPreceding, 0)
    filled = counted.select(
        "band",
        "thr",
        F.sum("n").over(whole).alias("n_total"),
        F.sum("pos").over(whole).alias("n_dep"),
        F.sum("n").over(from_here).alias("n_b"),
        F.sum("pos").over(from_here).alias("_db"),
    ).where(F.col("thr").isNotNull())
    others = F.col("n_total") - F.col("n_b")
    floor = F.lit(0.5)
    n_db = F.greatest("_db", floor)
    n_dnb = F.greatest(F.col("n_dep") - F.col("_db"), floor)
    usable = (F.col("n_b") >= 10) & (others >= 10) & (F.col("n_dep") >= 10) & (F.col("n_total") - F.col("n_dep") >= 100)
    return filled.where(usable).select(
        "band",
        "thr",
        "n_total",
        "n_dep",
        "n_b",
        n_db.alias("n_db"),
        n_dnb.alias("n_dnb"),
        F.greatest(F.col("n_b") - n_db, floor).alias("n_ndb"),
        F.greatest(others - n_dnb, floor).alias("n_ndnb"),
    )


def woe_weights(contingency: DataFrame) -> DataFrame:
    """Add w_plus, w_minus, contrast and its studentised form."""
    n_non = F.col("n_total") - F.col("n_dep")
    w_plus = F.ln((F.col("n_db") / F.col("n_dep")) / (F.col("n_ndb") / n_non))
    w_minus = F.ln((F.col("n_dnb") / F.col("n_dep")) / (F.col("n_ndnb") / n_non))
    variance = 1 / F.col("n_db") + 1 / F.col("n_ndb") + 1 / F.col("n_dnb") + 1 / F.col("n_ndnb")
    return (
        contingency.withColumn("w_plus", w_plus)
        .withColumn("w_minus", w_minus)
        .withColumn("contrast", F.col("w_plus") - F.col("w_minus"))
        .withColumn("studentized", F.col("contrast") / (F.sqrt(variance) + 1e-8))
    )


def woe_best_threshold(weights: DataFrame, decimals: int | None = None) -> DataFrame:
    """The threshold with the largest absolute contrast per band, the lowest on ties."""
    size = F.abs("contrast") if decimals is None else F.round(F.abs("contrast"), decimals)
    order = Window.partitionBy("band").orderBy(size.desc(), "thr")
    best = weights.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == 1).drop("_k")
    return best.withColumn("significant", F.abs("studentized") >= 1.5)


def woe_fit(cells: DataFrame, bands: Sequence[str], label: str = "label", decimals: int | None = None, **options) -> DataFrame:
    """Best threshold and weights per band, from the whole table."""
    thresholds = band_thresholds(cells, bands, decimals, **options)
    tie = None if decimals is None else 9
    return woe_best_threshold(woe_weights(woe_contingency(cells, bands, thresholds, label)), tie)


def prior_logit(cells: DataFrame, first_band: str, label: str = "label") -> float:
    """Log prior odds over the cells where the first band is known."""
    known = cells.where(F.col(first_band).isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos")
    ).first()
    return math.log(known["pos"] / max(known["n"] - known["pos"], 1) + 1e-8)


def woe_posterior(cells: DataFrame, fitted: DataFrame, first_band: str, label: str = "label") -> DataFrame:
    """Add `posterior`; an unknown band adds nothing to the logit, so it is never NULL.

    The fitted table has one row per band of the schema and becomes constants.
    """
    logit: Column = F.lit(prior_logit(cells, first_band, label))
    for w in sorted(fitted.collect(), key=lambda r: r["band"]):
        v = F.col(w["band"]).cast("double")
        logit = logit + F.when(v >= w["thr"], w["w_plus"]).when(v < w["thr"], w["w_minus"]).otherwise(0.0)
    return cells.withColumn("posterior", sigmoid(logit))
