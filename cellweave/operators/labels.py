"""Labels, spatial folds, hashed sampling and sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.scale import running_totals, small_side, smallest_by_key
from cellweave.session import stored

#: Values of `sampling_key`.
KEY_RANGE = 1 << 20
#: Leading digits of `sampling_hash` that a stratified sample counts, and how many such keys there are: few enough for
#: every task to fold its rows, and the rows of one key are few enough to be ranked.
SAMPLE_DIGITS = 3
SAMPLE_KEYS = 16**SAMPLE_DIGITS
#: Slots that a row of a weighted draw is unrolled into at once.
STRETCH = 4096


def label_bands(cells: DataFrame, labels: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Cells with their label (0 where none is given) and mask columns."""
    joined = cells.join(labels, ["row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return joined if masks is None else joined.join(masks, ["row", "col"], "left")


def label_balance(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and percentages of positive and unlabeled cells."""
    counted = cells.groupBy(*by).agg(
        F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_unlabeled"), F.count("*").alias("n")
    )
    return counted.withColumn("pct_positive", 100.0 * F.col("n_positive") / F.col("n")).withColumn(
        "pct_unlabeled", 100.0 * F.col("n_unlabeled") / F.col("n")
    )


def fold_strips(width: int, folds: int = 5, buffer: int = 400) -> list[dict[str, int]]:
    """Column intervals per fold: the test strip and the two ends of the training region."""
    strips = []
    for k in range(folds):
        start, end = int(k * width / folds), int((k + 1) * width / folds)
        strips.append({"fold": k, "start": start, "end": end, "train_left": max(0, start - buffer), "train_right": min(width, end + buffer)})
    return strips


def spatial_folds(cells: DataFrame, strips: Sequence[dict[str, int]]) -> DataFrame:
    """One row per (cell, fold) that uses it: the cell's columns, `fold` and `region`.

    A cell is `test` in its own strip and `train` in the folds whose strip is farther away
    than the buffer.  The fold table is an array of a handful of structs unrolled per row,
    so nothing is joined or shuffled; folds that do not use the cell go after that.
    """
    col = F.col("col")

    def use(s: dict[str, int]) -> Column:
        region = F.when((col >= s["start"]) & (col < s["end"]), "test").when(
            (col < s["train_left"]) | (col >= s["train_right"]), "train"
        )
        return F.struct(F.lit(s["fold"]).cast("bigint").alias("fold"), region.alias("region"))

    unrolled = cells.withColumn("_use", F.explode(F.array(*[use(s) for s in strips])))
    return unrolled.where(F.col("_use.region").isNotNull()).select(*cells.columns, "_use.fold", "_use.region")


def fold_masks(cells: DataFrame, strips: Sequence[dict[str, int]]) -> DataFrame:
    """Masks as rows `fold, kind, row, col`: test_pos, train_pos, train_unl and both regions."""
    used = spatial_folds(cells.select("row", "col", "label"), strips)
    positive = F.col("label") == 1
    kinds = F.array(
        F.when(F.col("region") == "test", F.lit("test_region")).otherwise(F.lit("train_region")),
        F.when((F.col("region") == "test") & positive, F.lit("test_pos"))
        .when((F.col("region") == "train") & positive, F.lit("train_pos"))
        .when(F.col("region") == "train", F.lit("train_unl")),
    )
    return used.select("fold", F.explode(F.array_compact(kinds)).alias("kind"), "row", "col")


def fold_counts(cells: DataFrame, strips: Sequence[dict[str, int]]) -> DataFrame:
    """Per fold: n_test_pos, n_train_pos, n_train_unl."""
    used = spatial_folds(cells.select("col", "label"), strips)
    test, positive = F.col("region") == "test", F.col("label") == 1
    return used.groupBy("fold").agg(
        F.count_if(test & positive).alias("n_test_pos"),
        F.count_if(~test & positive).alias("n_train_pos"),
        F.count_if(~test & (F.col("label") == 0)).alias("n_train_unl"),
    )


def exclude_fold_tiles(
    tiles: DataFrame, test_positive: DataFrame, patch: int, buffer_cols: int = 0, col: str = "c"
) -> DataFrame:
    """Drop tiles whose centre column lies between the outermost test positives (inclusive).

    Without test positives every tile is kept.  `buffer_cols` widens the interval.
    """
    edges = test_positive.agg(F.min("col").alias("lo"), F.max("col").alias("hi")).first()
    if edges["lo"] is None:
        return tiles
    centre = F.col(col) + patch // 2
    return tiles.where(~centre.between(edges["lo"] - buffer_cols, edges["hi"] + buffer_cols))


def interior(cells: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """Cells that can be the centre of a full patch."""
    rows = (F.col("row") >= half) & (F.col("row") < height - half)
    return cells.where(rows & (F.col("col") >= half) & (F.col("col") < width - half))


def sampling_hash(seed: int | Column, row: str = "row", col: str = "col") -> Column:
    """Deterministic pseudo-random order of cells: 128 bits as hexadecimal text, equal in every SQL engine.

    Each seed gives an unrelated order, also of any two cells.
    """
    return F.md5(F.concat_ws("-", F.col(row), F.col(col), F.lit(seed)))


def sampling_key(seed: int | Column, row: str = "row", col: str = "col") -> Column:
    """The first five digits of `sampling_hash` as a number below KEY_RANGE: a bounded key that can be counted."""
    return F.conv(F.substring(sampling_hash(seed, row, col), 1, 5), 16, 10).cast("bigint")


def stratified_sample(
    cells: DataFrame, ratio: float | Column, seed: int | Column = 42, cap: int | Column | None = None, by: Sequence[str] = (), **options
) -> DataFrame:
    """All (or `cap`) positives and `ratio` unlabeled cells per positive, without replacement.

    `by` makes independent samples per group; `ratio`, `seed` and `cap` may be expressions over it.
    The order is that of `sampling_hash`; its leading digits are counted, the rest decides among the rows of the last key.
    """
    by = list(by)
    hashed = sampling_hash(seed)
    # Written once, so that the hash of every row is not found again by each of the passes below.
    keyed = stored(cells.withColumn("_key", F.substring(hashed, 1, SAMPLE_DIGITS)), "keyed").withColumn("_tie", hashed)
    counts = keyed.groupBy(*by, "label").count()
    per_group = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("count"))), F.lit(0)).alias("_np"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("count"))), F.lit(0)).alias("_nu"),
    )
    n_pos = F.col("_np") if cap is None else F.least(F.col("_np"), F.lit(cap))  # least skips a NULL cap
    quotas = per_group.select(
        *by, n_pos.alias("_q1"), F.least(F.floor(n_pos * ratio), F.col("_nu")).cast("bigint").alias("_q0")
    )
    if by:
        keyed = keyed.join(small_side(quotas), by)
        return smallest_by_key(
            keyed, "_key", ["_tie", "row", "col"], F.when(F.col("label") == 1, F.col("_q1")).otherwise(F.col("_q0")), [*by, "label", "_q1", "_q0"],
            keys_at_most=SAMPLE_KEYS, follow=["_q1", "_q0"], **options,
        ).drop("_key", "_tie", "_q1", "_q0")
    row = quotas.first()
    quota = F.when(F.col("label") == 1, F.lit(row["_q1"])).otherwise(F.lit(row["_q0"]))
    return smallest_by_key(keyed, "_key", ["_tie", "row", "col"], quota, ["label"], keys_at_most=SAMPLE_KEYS, **options).drop("_key", "_tie")


def with_weights(samples: DataFrame, positive: float = 1.0, unlabeled: float = 0.1) -> DataFrame:
    return samples.withColumn("weight", F.when(F.col("label") == 1, positive).otherwise(unlabeled))


def positives_and_unlabeled(positives: DataFrame, unlabeled: DataFrame) -> DataFrame:
    """Training table of both classes with label and weight."""
    labelled = positives.select("row", "col", F.lit(1).cast("bigint").alias("label"))
    return with_weights(labelled.unionByName(unlabeled.select("row", "col", F.lit(0).cast("bigint").alias("label"))))


def random_split(items: DataFrame, seed: int, row: str = "row", col: str = "col", fraction: float = 0.1, **options) -> DataFrame:
    """Add `split`: the max(1, int(n * fraction)) items that come first in the order of `sampling_hash` are `val`.

    Counts by key, and by hash within the one key on the edge, give the last hash that is `val`; every row then
    compares itself with it, and nothing is joined back.  Repeated items share a hash and so their side.
    """
    n_val = max(1, int(items.count() * fraction))
    keyed = items.withColumns({"_key": sampling_key(seed, row, col), "_tie": sampling_hash(seed, row, col)})

    def reach(column: str, rows: DataFrame, wanted: int, **bounds) -> tuple[object, int] | None:
        """The first value of `column` up to which there are `wanted` rows, and how many rows come before it."""
        counts = running_totals(rows.groupBy(column).agg(F.count("*").alias("_n")), column, ["_n"], **bounds, **options)
        last = counts.where(F.col("cum__n") >= wanted).orderBy(column).limit(1).first()
        return None if last is None else (last[column], last["cum__n"] - last["_n"])

    edge = reach("_key", keyed, n_val, at_most=KEY_RANGE)
    if edge is None:  # no items
        return items.withColumn("split", F.lit("train"))
    last, _ = reach("_tie", keyed.where(F.col("_key") == edge[0]), n_val - edge[1])
    # The key is the beginning of the hash, so the hash alone orders the items.
    return keyed.withColumn("split", F.when(F.col("_tie") <= last, "val").otherwise("train")).drop("_key", "_tie")


def weighted_draw(items: DataFrame, weight: str, key: str, seed: int = 42, n: int | None = None, units: int = 1_000_000, **options) -> DataFrame:
    """Draw `n` (default: all) rows with replacement, proportionally to `weight`; adds `draw`.

    Weights are counted in whole `units` per 1, so the slices of [0, total) that the items own leave neither gaps
    nor overlaps.  The range is cut into n equal slots: an item is unrolled into the slots it overlaps (n +
    items rows in all), a draw falls into one slot, and an equi-join on the slot replaces the interval join.
    An item with a large slice is first unrolled into stretches of slots, which are dealt out to all tasks.
    """
    whole = items.withColumn("_units", F.round(F.col(weight) * units).cast("bigint"))
    running = running_totals(whole, key, ["_units"], **options)
    size = whole.agg(F.count("*").alias("n"), F.sum("_units").alias("total")).first()
    n = size["n"] if n is None else n
    total = size["total"] or 0
    if total <= 0 or n == 0:
        return items.withColumn("draw", F.lit(0).cast("bigint")).where(F.lit(False))

    def slot(position: Column) -> Column:  # never decreases with the position
        return F.least(F.floor(position / total * n).cast("bigint"), F.lit(n - 1))

    high = F.col("cum__units")
    low = high - F.col("_units")
    owned = running.where("_units > 0").withColumns({"_from": slot(low), "_to": slot(high - 1)})
    owned = owned.withColumn("_start", F.explode(F.sequence(F.col("_from"), F.col("_to"), F.lit(STRETCH).cast("bigint"))))
    owned = owned.repartition(F.col("_start")).withColumn("_slot", F.explode(F.sequence(F.col("_start"), F.least(F.col("_start") + STRETCH - 1, F.col("_to")))))
    place = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id"), F.lit(seed))), 1, 15), 16, 10).cast("bigint")
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), (place % total).alias("_at"))
    hits = owned.join(draws.withColumn("_slot", slot(F.col("_at"))), "_slot").where((F.col("_at") >= low) & (F.col("_at") < high))
    return hits.select(*items.columns, "draw")
