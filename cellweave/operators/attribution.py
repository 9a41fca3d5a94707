"""Channel attributions of logistic scores, and the correlation of paired embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import linspace_values


def integrated_gradients(features: Sequence[str], weights: Sequence[float], bias: float, steps: int = 20) -> dict[str, Column]:
    """Attribution expressions of sigmoid(w.x + b) from a zero baseline.

    The gradient along feature i at x*alpha is p(1-p)*w_i, so one mean over alpha serves
    all features.
    """
    logit = F.lit(0.0)
    for f, w in zip(features, weights):
        logit = logit + F.col(f) * float(w)
    slope = F.lit(0.0)
    for alpha in linspace_values(0.0, 1.0, steps):
        p = 1.0 / (1.0 + F.exp(-(logit * alpha + float(bias))))
        slope = slope + p * (1.0 - p)
    return {f: slope / float(steps) * float(w) * F.col(f) for f, w in zip(features, weights)}


def attribution_summary(attributions: DataFrame, channel: str = "channel", label: str = "label", value: str = "value") -> DataFrame:
    """Mean |attribution| and n per channel: over all samples and per label, in one pass."""
    sets = attributions.select(F.col(channel), F.col(label), F.abs(F.col(value)).alias("_a"))
    grouped = sets.groupingSets([[F.col(channel), F.col(label)], [F.col(channel)]], F.col(channel), F.col(label))
    summary = grouped.agg(F.avg("_a").alias("importance"), F.count("*").alias("n"), F.grouping(label).alias("_g"))
    group = F.when(F.col("_g") == 1, "all").when(F.col(label) == 1, "positive").otherwise("unlabeled")
    return summary.select(channel, group.alias("label_group"), "importance", "n")


def sample_channel_mean(attributions: DataFrame, sample: str = "sample", channel: str = "channel", value: str = "value") -> DataFrame:
    """Mean |attribution| over the cells of each sample and channel."""
    return attributions.groupBy(sample, channel).agg(F.avg(F.abs(F.col(value))).alias("importance"))


def mean_attribution_map(attributions: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Mean |attribution| over samples for each channel and patch cell."""
    return attributions.groupBy(channel, "row", "col").agg(F.avg(F.abs(F.col(value))).alias("importance"))


def trace_correlation(pairs: DataFrame, first: str, second: str, regularization: float = 1e-4, dims: int | None = None) -> DataFrame:
    """One row `loss`: minus the trace correlation of two array columns.

    The traces need only per-dimension (co)variances, so the arrays are unrolled by position
    and aggregated map-side; no dimension x dimension matrix appears.
    """
    zipped = pairs.select(F.posexplode(F.arrays_zip(F.col(first).alias("a"), F.col(second).alias("b"))).alias("d", "p"))
    typed = zipped.select("d", F.col("p.a").cast("double").alias("a"), F.col("p.b").cast("double").alias("b"))
    per_dim = typed.groupBy("d").agg(
        F.covar_samp("a", "b").alias("xy"), F.var_samp("a").alias("xx"), F.var_samp("b").alias("yy")
    )
    total = per_dim.agg(
        F.sum("xy").alias("xy"), F.sum(F.col("xx") + regularization).alias("xx"), F.sum(F.col("yy") + regularization).alias("yy")
    )
    return total.select((-F.col("xy") / (F.sqrt("xx") * F.sqrt("yy") + 1e-8)).alias("loss"))
