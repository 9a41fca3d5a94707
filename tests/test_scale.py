import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.scale import bounded_rows, broadcast_if_small, exact_percentiles, running_totals, small_side, smallest_by_key, spread

PROBS = [0.0, 0.02, 0.1, 0.5, 0.77, 0.98, 1.0]


def _values(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double").repartition(6)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(7)
    return {
        "hot": np.concatenate([np.full(900, 3.25), rng.normal(size=700)]),  # one value holds more than half
        "tail": np.concatenate([rng.lognormal(0, 6, 800), [1e30, -1e30]]),
        "small": rng.integers(0, 5, 40).astype(float),
        "single": np.array([2.5]),
    }


@pytest.mark.parametrize("limit", [10, 60, 10_000])
def test_percentiles_equal_numpy_on_every_path(spark, groups, limit):
    found = exact_percentiles(_values(spark, groups), "v", PROBS, ["g"], task_rows=limit).collect()
    assert {r["g"] for r in found} == set(groups)
    for r in found:
        expected = np.percentile(groups[r["g"]], [100 * p for p in PROBS])
        assert r["n"] == len(groups[r["g"]])
        assert np.allclose(r["pct"], expected, rtol=1e-9, atol=1e-12)


def test_percentiles_without_group_and_with_nulls(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)] + [(float(i),) for i in range(101)], "v double")
    for limit in (5, 1000):
        row = exact_percentiles(df, "v", [0.5, 0.98], task_rows=limit).first()
        assert list(row["pct"]) == [50.0, 98.0]


@pytest.mark.parametrize("limit", [50, 100_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_small_and_range_partitioned(spark, limit, descending):
    rng = np.random.default_rng(1)
    rows = [(g, int(k), int(rng.integers(1, 9))) for g in ("a", "b") for k in rng.permutation(700 if g == "a" else 30)]
    df = spark.createDataFrame(rows, "g string, k bigint, n bigint").repartition(5)
    got = running_totals(df, "k", ["n"], ["g"], descending=descending, task_rows=limit).collect()
    assert len(got) == len(rows)
    for g in ("a", "b"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: -r["k"] if descending else r["k"])
        assert [r["cum_n"] for r in mine] == list(np.cumsum([r["n"] for r in mine]))


def test_running_totals_without_group(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    got = running_totals(df, "k", ["n"], task_rows=40)
    assert got.where("cum_n = k + 1").count() == 500


@pytest.mark.parametrize("limit", [20, 100_000])
def test_smallest_by_key_is_exact_when_one_key_is_hot(spark, limit):
    # a third of the rows share one key
    df = spark.range(900).select(
        F.col("id"), (F.col("id") % 2).alias("s"), F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") * 7 % 101).alias("k")
    )
    got = smallest_by_key(df, "k", ["id"], F.when(F.col("s") == 1, 130).otherwise(300), ["s"], task_rows=limit)
    rows = df.collect()
    for s, quota in ((0, 300), (1, 130)):
        expected = sorted((r["k"], r["id"]) for r in rows if r["s"] == s)[:quota]
        assert sorted((r["k"], r["id"]) for r in got.where(F.col("s") == s).collect()) == expected


def test_quota_above_the_stratum_takes_everything(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert smallest_by_key(df, "k", ["id"], F.lit(99)).count() == 10
    assert smallest_by_key(df, "k", ["id"], F.lit(0)).count() == 0


def test_small_side_is_checked(spark):
    df = spark.range(20)
    assert bounded_rows(df, 19) is None and len(bounded_rows(df, 20)) == 20
    assert small_side(df, 5) is df
    plan = spark.range(1000).join(small_side(df, 50), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("limit", [5, 1000])
def test_percentiles_of_infinities(spark, limit):
    values = np.concatenate([np.full(7, -np.inf), np.linspace(-3, 9, 60), np.full(9, np.inf)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = exact_percentiles(df, "v", [0.0, 0.05, 0.3, 0.5, 0.95, 1.0], task_rows=limit).first()["pct"]
    order = np.sort(values)
    for p, got in zip([0.0, 0.05, 0.3, 0.5, 0.95, 1.0], found, strict=True):
        at = p * (len(order) - 1)
        low, high = order[int(np.floor(at))], order[int(np.ceil(at))]
        assert got == low if low == high else abs(got - (low + (high - low) * (at - np.floor(at)))) < 1e-9


def test_sides_that_are_not_small_are_never_broadcast(spark):
    """Unrolled rows do not show in Spark's estimate, which alone would broadcast this side."""
    base = spark.range(100)
    side = base.select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    cells = spark.range(1000)

    def plan(joined):
        return joined._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(cells.join(broadcast_if_small(side, base, 10, 1000), "id"))
    many = cells.join(broadcast_if_small(side, base, 10, 999), "id")
    assert "SortMergeJoin" in plan(many) and "Broadcast" not in plan(many)
    assert many.count() == 1000


def test_spread_deals_few_parts_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(1000).coalesce(1)
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() == 4 * cores
    assert sorted(r["id"] for r in dealt.collect()) == list(range(1000))
    assert spread(spark.range(0, 1000, 1, 4 * cores)).rdd.getNumPartitions() == 4 * cores


def test_many_customers_are_not_gathered_for_the_cells(spark, tmp_path, monkeypatch):
    """Spark's estimate by file bytes would send the customers through the driver."""
    from cellweave.catalog import fixtures

    spark.createDataFrame([(i, i, 10.5 * i) for i in range(4)], "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(1, 0, 10.0, "1-URGENT"), (2, 3, 20.0, "5-LOW"), (3, None, 30.0, "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 45.0, 0.1, 0.02, "R"), (1, 5.0, 0.05, 0.04, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(0, 1): (0.0, 1), (0, 2): (31.5, 0), (0, 3): (None, 0)}
    for limit, merged in ((4, False), (3, True)):
        monkeypatch.setattr(fixtures, "CUSTOMER_ROWS", limit)
        cells = fixtures.cells(spark, str(tmp_path))
        assert ("strategy=merge" in cells._jdf.queryExecution().optimizedPlan().toString()) == merged
        assert {(r["row"], r["col"]): (r["b5"], r["label"]) for r in cells.collect()} == want


def test_texts_of_segments_are_lowered_by_row(spark, tmp_path):
    """Lowering constants is the optimizer's work, and loads Spark's case tables on the driver."""
    from cellweave.catalog import metrics

    spark.createDataFrame([(7,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    segments = ["MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE", None, "machinery"]
    rows = [(i, float(i), s) for i, s in enumerate(segments)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    typed = metrics.typed_points(spark, str(tmp_path)).select("id", "dep_type")
    assert "lower(" in typed._jdf.queryExecution().optimizedPlan().toString()
    assert [r[1] for r in typed.orderBy("id").collect()] == ["gold", "iron", "chromite", "polymetallic", "unknown", "unknown", "unknown"]


def test_percentiles_of_brackets_from_a_draw(spark, groups, monkeypatch):
    from cellweave import scale

    monkeypatch.setattr(scale, "SKETCH_ROWS", 40)  # brackets come from some forty values and may miss
    known = {**groups, None: np.arange(900.0)}
    found = exact_percentiles(_values(spark, known), "v", PROBS, ["g"], task_rows=60).collect()
    assert {r["g"]: r["n"] for r in found} == {g: len(v) for g, v in known.items()}
    for r in found:
        assert np.allclose(r["pct"], np.percentile(known[r["g"]], [100 * p for p in PROBS]), rtol=1e-9, atol=1e-12)
