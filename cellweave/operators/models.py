"""Classifiers over cell and tile tables, on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from typing import TypeVar

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import sigmoid
from cellweave.operators.labels import stratified_sample, with_weights
from cellweave.operators.logistic import fit_logistic_groups
from cellweave.operators.tiles import pass_mean_std, tile_overlap_mean
from cellweave.operators.trees import ORDERED_ROWS, Binned, Grown, Part, Sample, grow_forests, row_codes
from cellweave.session import keep_checkpoints, stored


T = TypeVar("T")

#: Rows of a fit that one task holds; a smaller sample is one task, so that parts of forests grow side by side.
TASK_ROWS = 100_000
#: Rows of a fit that are read by the driver; the thresholds of more are told and their equal rows counted by Spark.
READ_ROWS = 400_000
#: Rows that differ in a threshold, label or weight, of the samples that are sent to every task together.
SENT_ROWS = 6_000_000
#: Trees of a part of a forest. A part grows all its trees level by level.
PART_TREES = 63
#: Parts that grow at the same time.
AT_ONCE = 8


def in_parallel(jobs: Sequence[Callable[[], T]], at_once: int = AT_ONCE) -> list[T]:
    """Results of independent fits, a few of them submitted to the cluster at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda job: job(), jobs))


@dataclass(frozen=True)
class Forest:
    """A random forest in parts. Its probability is the mean over all trees, like that of one fit."""

    assembler: VectorAssembler
    parts: tuple[RandomForestClassificationModel | Part, ...]
    trees: tuple[int, ...]
    grown: Grown | None = None
    cuts: tuple[np.ndarray, ...] | None = None  # where Spark ML was given numbers of thresholds, not features

    def vectors(self, rows: DataFrame) -> DataFrame:
        """Add `_features`; rows with unknown features go."""
        if self.cuts is None:
            return self.assembler.transform(rows)
        features = self.assembler.getInputCols()
        return rows.dropna(subset=features).withColumn("_features", array_to_vector(row_codes(self.cuts, features)))


def fit_forests(
    trains: Sequence[DataFrame], features: Sequence[str], trees: int = 500, depth: int = 30, min_leaf: int = 5, seed: int = 42,
    weight: str = "weight",
) -> list[Forest]:
    """Random forests on weighted samples, one for each table; depth 30 is the deepest Spark ML grows.

    Rows are told by the thresholds that they lie above, which are found from all rows, and equal ones are counted once. Samples of
    up to SENT_ROWS such rows are sent to every task, some at a time when they are more together, and their trees are dealt over the
    tasks (`trees`). Forests of larger tables are assembled from seeded parts of about PART_TREES trees that grow side by side, all
    tables' parts together, by Spark ML, which gets the same thresholds as numbers. Its tasks keep the node of every row
    (checkpointed in the shared folder), so that trees are not sent along with each level.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    count = max(1, round(trees / PART_TREES))
    sizes = tuple(trees // count + (k < trees % count) for k in range(count))
    forests: dict[int, Forest] = {}
    waiting: dict[int, Sample | Binned] = {}
    large: dict[int, tuple[np.ndarray, ...] | None] = {}

    def grow_waiting() -> None:
        grown = grow_forests(trains[0].sparkSession, list(waiting.values()), sizes, depth, min_leaf, seed) if waiting else []
        for i, (forest, parts) in zip(waiting, grown, strict=True):
            forests[i] = Forest(assembler, parts, sizes, forest)
        waiting.clear()

    for i, train in enumerate(trains):
        read = Sample.of(train, features, weight, READ_ROWS)
        if read is None:
            cuts, sample = Binned.of(train, features, weight, SENT_ROWS) or (None, None)
        else:
            binned = read.binned().merged()
            cuts, sample = binned.cuts, read if len(read.y) <= ORDERED_ROWS else binned
        if sample is None or len(sample.y) > SENT_ROWS:
            large[i] = cuts
            continue
        if sum(len(w.y) for w in waiting.values()) + len(sample.y) > SENT_ROWS:
            grow_waiting()
        waiting[i] = sample
    grow_waiting()

    def grow(ready: DataFrame, k: int) -> RandomForestClassificationModel:
        return RandomForestClassifier(
            featuresCol="_features", labelCol="label", weightCol=weight, numTrees=sizes[k], maxDepth=depth, minInstancesPerNode=min_leaf,
            seed=seed + k, maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10, probabilityCol="_probability",
        ).fit(ready)

    jobs = []
    for i, cuts in large.items():
        train = trains[i]
        keep_checkpoints(train.sparkSession)
        empty = Forest(assembler, (), sizes, cuts=cuts)
        ready = empty.vectors(train.withColumn("label", F.col("label").cast("double"))).select("_features", "label", weight)
        ready = ready.coalesce(max(1, math.ceil(train.count() / TASK_ROWS)))
        jobs += [partial(grow, ready, k) for k in range(count)]
    grown = in_parallel(jobs)
    for n, (i, cuts) in enumerate(large.items()):
        forests[i] = Forest(assembler, tuple(grown[n * count : (n + 1) * count]), sizes, cuts=cuts)
    return [forests[i] for i in range(len(trains))]


def fit_forest(train: DataFrame, features: Sequence[str], **options) -> Forest:
    return fit_forests([train], features, **options)[0]


def fit_logistic(train: DataFrame, features: Sequence[str], weight: str = "weight", l2: float = 1e-4) -> list[float]:
    """Weighted positive-unlabeled logistic model: its bias and weights."""
    return fit_logistic_groups(train, features, weight=weight, l2=l2).get(("full",), [0.0] * (len(features) + 1))


def score(model: Forest, cells: DataFrame, name: str = "score") -> DataFrame:
    """Add the probability of the positive class; of the only class when there is one. Rows with null features go."""
    if model.grown is not None:
        features = model.assembler.getInputCols()
        return model.grown.score(cells.dropna(subset=features), features, name)
    scored, total = model.vectors(cells), F.lit(0.0)
    for k, (part, trees) in enumerate(zip(model.parts, model.trees, strict=True)):
        p = F.col(f"_p{k}")
        scored = part.transform(scored).withColumn(f"_p{k}", vector_to_array(F.col("_probability"))).drop("_probability", "rawPrediction", "prediction")
        total = total + F.when(F.size(p) > 1, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0))) * trees
    return scored.withColumn(name, total / sum(model.trees)).drop("_features", *[f"_p{k}" for k in range(len(model.parts))])


def score_linear(terms: Sequence[float], features: Sequence[str], cells: DataFrame, name: str = "score") -> DataFrame:
    """Add the probability of a logistic model."""
    return cells.withColumn(name, sigmoid(logit(features, terms)))


def forest_importance(model: Forest, features: Sequence[str], spark) -> DataFrame:
    """`feature, importance, rank`: impurity importances, the mean over all trees, largest first."""
    values = sum(part.featureImportances.toArray() * trees for part, trees in zip(model.parts, model.trees, strict=True))
    values = values / (values.sum() or 1.0)
    ordered = sorted(zip(features, (float(v) for v in values)), key=lambda p: (-p[1], p[0]))
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(ordered)]
    return spark.createDataFrame(rows, "feature string, importance double, rank bigint")


def top_features(importances: DataFrame, n: int = 5) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def logit(features: Sequence[str], terms: Sequence[float]) -> Column:
    total = F.lit(float(terms[0]))
    for f, w in zip(features, terms[1:], strict=True):
        total = total + F.col(f) * float(w)
    return total


def fit_ensemble(samples: DataFrame, features: Sequence[str], passes: int, ratio: float = 5.0, seed: int = 42) -> list[list[float]]:
    """Terms of logistic models, each fitted on its own unlabeled draw.

    All passes are drawn as groups of one job and fitted together.
    """
    every = samples.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    drawn = stratified_sample(every, ratio, F.lit(seed) + F.col("pass"), by=["pass"])
    fitted = fit_logistic_groups(stored(with_weights(drawn), "draws"), features, ["pass"])
    return [fitted[k] for k in sorted(fitted)]


def ensemble_uncertainty(
    cells: DataFrame, features: Sequence[str], ensemble: Sequence[Sequence[float]], keys: Sequence[str]
) -> DataFrame:
    """Mean and sample deviation over the ensemble per row; nothing is shuffled."""
    probabilities = F.array(*[sigmoid(logit(features, terms)) for terms in ensemble])
    # The generator binds the array, so each member is evaluated once.
    scored = cells.select(*keys, F.explode(F.array(probabilities)).alias("_p"))
    mean, std = pass_mean_std(F.col("_p"))
    return scored.select(*keys, mean.alias("mean"), std.alias("std"))


def score_tiles(scored: DataFrame, height: int, width: int, patch: int, stride: int) -> DataFrame:
    """Spread the scores of tiles (`row, col` is the centre) over the cells."""
    return tile_overlap_mean(scored, ["score"], height, width, patch, stride)


def pixel_map(cells: DataFrame, model: Forest, valid: Column, nodata: float = -9999.0) -> DataFrame:
    """`row, col, score`: predictions for all valid cells, the rest nodata.

    `cells` must be prepared (filled, scaled) like the rows that the model was fitted on.
    """
    marked = cells.withColumn("_valid", valid)
    predicted = score(model, marked.where("_valid")).select("row", "col", "score")
    rest = marked.where("not coalesce(_valid, false)").select("row", "col", F.lit(nodata).alias("score"))
    return predicted.unionByName(rest)
