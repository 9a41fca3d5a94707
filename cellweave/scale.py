"""Building blocks that keep global statistics and global orders distributed.

Three things in this library need a view of the whole table: percentiles, running
totals over a global order, and "the n smallest rows" of a stratum.  Written naively
each of them ends in one task.  The helpers below do the bulk in map-side-combined
aggregations and only hold results whose row count has been checked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import checkpointed

#: Rows of a lookup table that the driver may hold.
LOOKUP_ROWS = 20_000
#: Rows of a narrow join side that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Rows of one group that one task is asked to sort or to hold.
TASK_ROWS = 2_000_000
#: Values of a large group that bracket its percentiles before all of its values are counted.
SKETCH_ROWS = 200_000


def bounded_rows(df: DataFrame, limit: int = LOOKUP_ROWS) -> list[Row] | None:
    """The rows of `df` when there are at most `limit`, else None; never reads more than limit+1."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_side(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """Broadcast `df` when it is checked to be small; otherwise leave the join to AQE.

    The checked rows become a local relation, so the side is computed once.
    """
    rows = bounded_rows(df, limit)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_if_small(side: DataFrame, base: DataFrame | None = None, factor: int = 1, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `side` when it is checked to be small; otherwise have the join sort and merge.

    For sides too large for the driver to hold row by row: only a bounded count is taken.
    When every row of `base` gives at most `factor` rows of `side`, the cheaper `base` is counted.
    Spark sizes a side by the bytes of its files or shuffles, which know nothing of rows unrolled after them; a side
    that is not small must not be left to that estimate, which would gather it on the driver.
    """
    counted = side if base is None else base
    allowed = limit // factor
    return F.broadcast(side) if counted.limit(allowed + 1).count() <= allowed else side.hint("merge")


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Deal the rows of a table read from few files over all cores, for steps that cost far more than a row's bytes.

    Tables that come in more parts than that stay as they are, so at most `per_core` parts a core are moved.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def same_group(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on every key."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _rank_targets(probs: Sequence[float], n: int) -> list[int]:
    """Zero-based order statistics that linear interpolation at `probs` needs."""
    wanted: set[int] = set()
    for p in probs:
        position = p * (n - 1)
        wanted.add(math.floor(position))
        wanted.add(math.ceil(position))
    return sorted(wanted)


def _interpolate(p: float, n: int, at: dict[int, float]) -> float:
    position = p * (n - 1)
    low, high = math.floor(position), math.ceil(position)
    return at[low] if at[low] == at[high] else at[low] * (high - position) + at[high] * (position - low)


def exact_percentiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    by: Sequence[str] = (),
    *,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group: `by..., n, pct ARRAY<DOUBLE>`.

    Groups of up to `task_rows` rows use the built-in `percentile`.  For a larger group
    the built-in would merge every distinct value in one task, so a mergeable quantile sketch
    of some of its values brackets its order statistics, and one scan that counts all values
    finds them among the few inside the brackets, or says that the brackets must be wider.
    That scan then serves smaller groups, too, down to a twentieth of `task_rows`.
    """
    by = list(by)
    source = value if isinstance(value, Column) else F.col(value)
    base = df.select(*by, source.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    probs = [float(p) for p in probs]

    largest = base.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(LOOKUP_ROWS + 1).collect()
    hot = [g for g in largest if g["n"] > task_rows // 20] if any(g["n"] > task_rows for g in largest) else []
    array_type = ", ".join(f"{p!r}D" for p in probs)

    def builtin(part: DataFrame) -> DataFrame:
        return part.groupBy(*by).agg(
            F.count("*").alias("n"), F.expr(f"percentile(_v, array({array_type}))").alias("pct")
        )

    if not hot:
        return builtin(base)

    spark = df.sparkSession
    found = _order_statistics(base, by, hot, probs, task_rows)
    fields = [base.schema[k] for k in by]
    schema = T.StructType(
        fields + [T.StructField("n", T.LongType()), T.StructField("pct", T.ArrayType(T.DoubleType()))]
    )
    rows = [
        (*[g[k] for k in by], g["n"], [_interpolate(p, g["n"], found[i]) for p in probs])
        for i, g in enumerate(hot)
    ]
    big = spark.createDataFrame(rows, schema)
    if len(hot) == len(largest) <= LOOKUP_ROWS:  # no other groups
        return big
    keys = F.broadcast(spark.createDataFrame([r[: len(by)] for r in rows], T.StructType(fields)))
    rest = base.join(keys, same_group(base, keys, by), "left_anti")
    return builtin(rest).unionByName(big)


def _order_statistics(base: DataFrame, by: list[str], hot: list[Row], probs: list[float], task_rows: int) -> list[dict[int, float]]:
    """Per hot group the values at the ranks that `probs` need.

    A sketch of at most about SKETCH_ROWS values of each group gives the values at p -+ slack, which should enclose rank
    p * (n - 1): the slack covers the sketch's error bound and five deviations of the draw.  The second scan reads all rows,
    counts those below each bracket as one key and those inside by value, so a running sum over the keys of a bracket is
    the global rank.  Should a rank fall outside its bracket after all, the slack grows and both scans are repeated.
    """
    spark = base.sparkSession
    fields = [base.schema[k] for k in by]
    plain = all(g[k] is not None for g in hot for k in by)  # then the cheaper equality finds the same rows

    def of_groups(rows: list[tuple], more: str) -> tuple[DataFrame, Column]:
        """A broadcast table with a row per hot group, and the condition that finds a row's group."""
        named = T.StructType([T.StructField(f"_k_{f.name}", f.dataType) for f in fields])
        schema = T.StructType(named.fields + T.StructType.fromDDL(more).fields)
        side = F.broadcast(spark.createDataFrame([(*[g[k] for k in by], *r) for g, r in zip(hot, rows)], schema))
        match = F.lit(True)
        for k in by:
            match = match & (base[k] == side[f"_k_{k}"] if plain else base[k].eqNullSafe(side[f"_k_{k}"]))
        return side, match

    shares = [min(1.0, SKETCH_ROWS / g["n"]) for g in hot]
    most = max(shares)
    accuracy = int(min(1_000_000, max(10_000, 16 * max(g["n"] for g in hot) // task_rows)))
    slack = 2 / accuracy + 2 / task_rows + (2.5 / math.sqrt(SKETCH_ROWS) if min(shares) < 1 else 0.0)
    drawn = base if most == 1 else base.where(F.rand(42) < most)
    while True:
        ends = ", ".join(f"{min(1.0, max(0.0, p + d))!r}D" for p in probs for d in (-slack, slack))
        side, match = of_groups([(i, s / most) for i, s in enumerate(shares)], "_g int, _share double")
        tagged = drawn.join(side, match).where((F.col("_share") >= 1) | (F.rand(43) < F.col("_share"))).select("_g", "_v")
        sketch = tagged.groupBy("_g").agg(F.expr(f"approx_percentile(_v, array({ends}), {accuracy})").alias("_e"))
        found_ends = {r["_g"]: r["_e"] for r in sketch.collect()}  # a row per hot group
        edges = []
        for i in range(len(hot)):
            known = found_ends.get(i)
            low = [-math.inf if known is None or p - slack <= 0 else known[2 * b] for b, p in enumerate(probs)]
            high = [math.inf if known is None or p + slack >= 1 else known[2 * b + 1] for b, p in enumerate(probs)]
            edges.append((i, low, high))
        side, match = of_groups(edges, "_g int, _lo array<double>, _hi array<double>")
        bracket = F.explode(F.array(*[F.lit(b) for b in range(len(probs))])).alias("_b") if len(probs) > 1 else F.lit(0).alias("_b")
        tagged = base.join(side, match).select("_g", "_v", "_lo", "_hi", bracket)
        within = F.when(F.col("_v") >= F.get("_lo", F.col("_b")), F.col("_v")).otherwise(-math.inf)  # not null: a key of the fast aggregation
        keyed = tagged.where(F.col("_v") <= F.get("_hi", F.col("_b"))).select("_g", "_b", within.alias("_x"))
        order = Window.partitionBy("_g", "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        counted = keyed.groupBy("_g", "_b", "_x").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))
        wanted = [(i, b, r) for i, g in enumerate(hot) for b, p in enumerate(probs) for r in _rank_targets([p], g["n"])]
        targets = F.broadcast(spark.createDataFrame(wanted, "_g int, _b int, _r long"))
        hits = counted.join(targets, ["_g", "_b"]).where((F.col("_r") < F.col("upto")) & (F.col("_r") >= F.col("upto") - F.col("n")))
        found: list[dict[int, float]] = [{} for _ in hot]
        for h in hits.select("_g", "_b", "_r", "_x").collect():  # two rows a group and probability
            if h["_x"] >= edges[h["_g"]][1][h["_b"]]:  # not among those below the bracket
                found[h["_g"]][h["_r"]] = h["_x"]
        if all(r in found[i] for i, _, r in wanted):
            return found
        slack *= 8


def percentile_values(df: DataFrame, value: str | Column, probs: Sequence[float], **options) -> list[float] | None:
    """Exact percentiles of one column as driver-side numbers; None when it has no value."""
    rows = exact_percentiles(df, value, probs, **options).collect()
    return list(rows[0]["pct"]) if rows and rows[0]["n"] else None


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    *,
    descending: bool = False,
    task_rows: int = TASK_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Add `cum_<name>` for each of `sums`, running over `order` within `by`.

    `df` must be unique on (by, order): aggregate it first, which also folds a hot value
    into one row.  A group that one task can sort uses a plain window.  Otherwise the rows
    are range-partitioned (balanced, because they are distinct), the placement is fixed
    with a checkpoint, and every part adds the total of the parts before it.

    `at_most` is a bound on the rows of a group that the caller can prove; when it fits a
    task the group sizes need not be counted.
    """
    by = list(by)
    direction = F.desc if descending else F.asc
    largest = (at_most, 0)
    if at_most is None or at_most > task_rows:
        largest = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    if (largest[0] or 0) <= task_rows:
        window = Window.partitionBy(*by).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(s).over(window).alias(f"cum_{s}") for s in sums])

    parts = math.ceil(largest[1] / task_rows) * 2
    placed = checkpointed(
        df.repartitionByRange(parts, *[F.col(k) for k in by], direction(order)).withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_part", *by).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_op"),
        *[F.col(k).alias(f"_o_{k}") for k in by],
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums],
    )
    offsets = small_side(offsets)
    match = placed["_part"] == offsets["_op"]
    for key in by:
        match = match & placed[key].eqNullSafe(offsets[f"_o_{key}"])
    within = Window.partitionBy("_part", *by).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(offsets, match).select(
        *df.columns, *[(F.sum(s).over(within) + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums]
    )


def smallest_by_key(
    df: DataFrame,
    key: str,
    ties: Sequence[str],
    quota: Column,
    by: Sequence[str] = (),
    *,
    task_rows: int = TASK_ROWS,
    keys_at_most: int | None = None,
    follow: Sequence[str] = (),
) -> DataFrame:
    """Per stratum, the `quota` rows that come first by (key, ties); exact at any size.

    Rows are first counted per key.  Keys wholly inside the quota are taken as they are;
    only the one key on the boundary is ranked, so no stratum is sorted in one task.
    `quota` is an expression over the `by` columns; `keys_at_most` a bound on the distinct keys; `follow` names those of
    `by` that are the same wherever the others are, so that they need not be compared.
    """
    by = list(by)
    counts = df.groupBy(*by, key).agg(F.count("*").alias("_n"))
    upto = running_totals(counts, key, ["_n"], by, task_rows=task_rows, at_most=keys_at_most)
    before = F.col("cum__n") - F.col("_n")
    last = (
        upto.where(before < quota)
        .groupBy(*by)
        .agg(F.max(F.struct(F.col(key).alias("key"), (quota - before).alias("room"), F.col("_n").alias("size"))).alias("_last"))
        .select(*[F.col(k).alias(f"_c_{k}") for k in by], "_last.key", "_last.room", "_last.size")
    )
    rows = bounded_rows(last)
    if rows is None:
        edge, largest = last, last.agg(F.max("size")).first()[0]
    else:
        edge = F.broadcast(df.sparkSession.createDataFrame(rows, last.schema))
        largest = max((r["size"] or 0 for r in rows), default=0)
    room = f"_room{len(ties)}"  # one per depth of the recursion below
    compared = [k for k in by if k not in follow]
    # Without nulls among the strata the cheaper equality finds the same rows.
    plain = rows is not None and all(r[f"_c_{k}"] is not None for r in rows for k in compared)
    match = df[key] <= edge["key"]
    for k in compared:
        match = match & (df[k] == edge[f"_c_{k}"] if plain else df[k].eqNullSafe(edge[f"_c_{k}"]))

    def taken(part: DataFrame) -> DataFrame:
        return part.join(edge, match).select(*[df[c] for c in df.columns], edge["key"].alias("_edge"), edge["room"].cast("bigint").alias(room))

    inside = taken(df).where(F.col(key) < F.col("_edge")).select(*df.columns)
    # Rows of other keys go before their ties, which may be costly, are computed for the join.
    last_keys = {r["key"] for r in rows or ()}
    narrow = df.where(df[key].isin(list(last_keys))) if rows is not None and len(last_keys) <= 1000 else df
    boundary = taken(narrow).where(F.col(key) == F.col("_edge")).drop("_edge")
    if largest > task_rows and ties:
        # One key holds too many rows to rank in a task: the next tie column decides among them.
        strata = list(dict.fromkeys([*by, key, room]))
        chosen = smallest_by_key(boundary, ties[0], list(ties[1:]), F.col(room), strata, task_rows=task_rows)
    else:
        ranked = Window.partitionBy(*by, key).orderBy(*ties) if ties else Window.partitionBy(*by, key).orderBy(key)
        chosen = boundary.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= F.col(room))
    return inside.unionByName(chosen.select(*df.columns))
