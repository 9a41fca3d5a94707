"""Run logs: epoch reduction, early stopping, ablation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_logs(runs: DataFrame, keys: Sequence[str], log: str = "log") -> DataFrame:
    """One row per epoch of a nested run log."""
    return runs.select(*keys, F.explode(log).alias("_l")).select(*keys, "_l.*")


def best_epoch(logs: DataFrame, keys: Sequence[str], metric: str = "auc_pr", epoch: str = "epoch") -> DataFrame:
    """`keys..., best_epoch, best_metric, n_epochs`: highest metric, the earliest epoch on ties."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("e")))
    return (
        logs.where(F.col(metric).isNotNull())
        .groupBy(*keys)
        .agg(best.alias("_b"), F.count("*").alias("n_epochs"))
        .select(*keys, (-F.col("_b.e")).alias("best_epoch"), F.col("_b.m").alias("best_metric"), "n_epochs")
    )


def early_stop(log: Column, min_delta: float = 0.0, patience: int = 10, freeze_epochs: int = 0) -> Column:
    """Fold an ARRAY<STRUCT<epoch, metric>> to STRUCT<best_metric, best_epoch, stop_epoch>.

    An epoch improves only above best + min_delta; the patience counter may end the run only
    after the frozen epochs.  `stop_epoch` is NULL for a run that was never stopped.  A run
    has as many epochs as it was configured for, so the array is small.
    """
    none = F.lit(None).cast("bigint")
    start = F.struct(F.lit(0.0).alias("best"), none.alias("at"), F.lit(0).cast("bigint").alias("waited"), none.alias("stopped"))

    def step(s: Column, e: Column) -> Column:
        better = e["metric"] > s["best"] + min_delta
        waited = F.when(better, F.lit(0).cast("bigint")).otherwise(s["waited"] + 1)
        stops = (waited >= patience) & (e["epoch"] > freeze_epochs)
        moved = F.struct(
            F.when(better, e["metric"]).otherwise(s["best"]).alias("best"),
            F.when(better, e["epoch"]).otherwise(s["at"]).alias("at"),
            waited.alias("waited"),
            F.when(stops, e["epoch"]).alias("stopped"),
        )
        return F.when(s["stopped"].isNotNull(), s).otherwise(moved)

    folded = F.aggregate(F.array_sort(log), start, step)
    return F.struct(
        folded["best"].alias("best_metric"), folded["at"].alias("best_epoch"), folded["stopped"].alias("stop_epoch")
    )


def reduce_logs(logs: DataFrame, keys: Sequence[str], metric: str, epoch: str = "epoch", **options) -> DataFrame:
    """Early-stopping result per run from one row per epoch."""
    log = F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("epoch"), F.col(metric).cast("double").alias("metric")))
    return logs.groupBy(*keys).agg(log.alias("_log")).select(*keys, early_stop(F.col("_log"), **options).alias("_r")).select(*keys, "_r.*")


def ablation_drop(results: DataFrame, metric: str, keys: Sequence[str] = ("fold",), full: str = "full") -> DataFrame:
    """`keys..., variant, metric, drop`: how much each variant loses against the full one."""
    base = results.where(F.col("variant") == full).select(*keys, F.col(metric).alias("_full"))
    joined = results.join(base, list(keys))
    return joined.select(*keys, "variant", metric, (F.col("_full") - F.col(metric)).alias("drop"))
