import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.grid import Grid
from cellweave.operators import spans as sp
from cellweave.operators.geometry import buffered_cells


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 2), st.integers(0, 12), st.integers(-1, 5)), max_size=25))
def test_merged_spans_cover_the_same_cells_without_touching(spark, given_spans):
    rows = [(k, r, lo, lo + more) for k, r, lo, more in given_spans]
    merged = sp.merged_spans(spark.createDataFrame(rows, "k string, row bigint, lo bigint, hi bigint"), ["k"]).collect()
    covered = [(m["k"], m["row"], c) for m in merged for c in range(m["lo"], m["hi"] + 1)]
    expected = {(k, r, c) for k, r, lo, hi in rows for c in range(lo, hi + 1)}
    assert len(covered) == len(set(covered)) and set(covered) == expected
    ends = {(m["k"], m["row"], m["hi"] + 1) for m in merged}
    assert not ends & {(m["k"], m["row"], m["lo"]) for m in merged}


@pytest.mark.parametrize("radius", [0.0, 30.0, 50.0, 170.0, 500.0])
def test_discs_equal_the_distance_test(spark, radius):
    grid = Grid(1000.0, 2000.0, 1900.0, 2700.0, 18, 14)
    points = [(1000.0, 2700.0), (1450.0, 2350.0), (1450.0, 2350.0), (1899.9, 2000.1), (700.0, 2500.0), (1500.0, 3199.0), (1333.3, 1501.0), (9e6, 0.0)]
    got = [(r["row"], r["col"]) for r in buffered_cells(spark.createDataFrame(points, "x double, y double"), grid, radius).collect()]

    def near(r, c, x, y):
        dx = max(1000.0 + c * 50 - x, x - (1000.0 + (c + 1) * 50), 0)
        dy = max(2700.0 - (r + 1) * 50 - y, y - (2700.0 - r * 50), 0)
        return dx * dx + dy * dy <= radius * radius

    expected = {(r, c) for r in range(14) for c in range(18) for x, y in points if near(r, c, x, y)}
    assert len(got) == len(set(got)) and set(got) == expected


def test_rows_before_the_last_step_grow_with_points_and_rows(spark):
    grid = Grid.of_shape(200, 200)
    points = spark.range(1000).select(F.lit(5000.0).alias("x"), (F.col("id") % 2 + 5000).cast("double").alias("y"))
    discs = sp.disc_spans(points, grid, 2000.0)
    assert discs.count() <= 1000 * (2 * math.floor(2000 / 50) + 3)
    assert sp.merged_spans(discs).count() <= 2 * math.floor(2000 / 50) + 3


def test_no_points_no_cells_and_null_points_take_no_part(spark):
    grid = Grid.of_shape(5, 5)
    schema = "x double, y double"
    assert buffered_cells(spark.createDataFrame([], schema), grid).count() == 0
    assert buffered_cells(spark.createDataFrame([(None, 1.0), (1.0, None)], schema), grid).count() == 0
