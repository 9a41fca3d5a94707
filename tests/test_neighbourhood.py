import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.grid import Grid
from cellweave.operators import neighbourhood as nb
from cellweave.operators.lines import filter_lines, reflected, squared_distance_lines


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(0, 30)), min_size=9, max_size=9), min_size=1, max_size=4))
def test_line_minimum_equals_brute_force(rows):
    gap = np.array([[np.nan if v is None else float(v) for v in r] for r in rows])
    got = squared_distance_lines(gap)
    for line, values in enumerate(gap):
        for c in range(9):
            costs = [(c - s) ** 2 + g * g for s, g in enumerate(values) if not np.isnan(g)]
            assert (np.isnan(got[line, c]) and not costs) or got[line, c] == min(costs)


def test_kernel_and_boundary():
    weights = nb.gaussian_weights(5.0)
    assert len(weights) == 41 and abs(weights.sum() - 1) < 1e-12
    assert list(reflected(np.array([[1.0, 2.0, 3.0]]), 4)[0]) == [3, 3, 2, 1, 1, 2, 3, 3, 2, 1, 1]
    assert np.allclose(filter_lines(np.full((2, 7), 4.0), nb.box_weights(9)), 4.0)


def test_distance_from_one_cell(spark, grid_of, dense):
    cells = grid_of([[1 if (r, c) == (2, 3) else 0 for c in range(7)] for r in range(6)])
    got = dense(nb.distance_transform(cells, F.col("v") == 1, Grid.of_shape(6, 7)), "distance")
    assert all(abs(d - 50 * np.hypot(r - 2, c - 3)) < 1e-9 for (r, c), d in got.items())


def test_distance_without_any_cell_is_unknown(spark, grid_of, dense):
    got = dense(nb.distance_transform(grid_of([[0] * 4] * 3), F.col("v") == 1, Grid.of_shape(3, 4)), "distance")
    assert set(got.values()) == {None}


def test_intersection_distance_is_zero_without_hits_and_null_with_unknown_input(spark):
    rows = [(r, c, 100.0 if c else None, 900.0) for r in range(2) for c in range(3)]
    cells = spark.createDataFrame(rows, "row bigint, col bigint, a double, b double")
    far = nb.nearest_feature_distance(cells, "a", "b", Grid.of_shape(2, 3)).collect()
    assert {r["distance"] for r in far} == {0.0}
    near = nb.nearest_feature_distance(cells.withColumn("b", F.lit(10.0)), "a", "b", Grid.of_shape(2, 3)).collect()
    assert {r["distance"] for r in near if r["col"] == 0} == {None}
    assert {r["distance"] for r in near if r["col"] > 0} == {0.0}


def test_contact_on_a_step_edge(spark, grid_of, dense):
    cells = grid_of([[1 if c < 2 else 4 for c in range(5)] for _ in range(5)])
    got = dense(nb.contact_mask(cells, "v"), "contact")
    assert {a for a, v in got.items() if v == 1.0} == {(r, 1) for r in range(5)}


def test_flat_field_has_no_variance_and_density_peaks_at_one(spark, grid_of, dense):
    flat = grid_of([[2.0] * 6] * 6)
    assert max(abs(v) for v in dense(nb.local_variance_sum(flat, ["v"], Grid.of_shape(6, 6)), "complexity").values()) < 1e-9
    spot = grid_of([[1 if (r, c) == (3, 3) else 0 for c in range(7)] for r in range(7)])
    got = dense(nb.gaussian_density(spot, ["v"], 1.0, Grid.of_shape(7, 7)), "v")
    assert got[(3, 3)] == 1.0 and max(got.values()) == 1.0 and abs(got[(2, 3)] - got[(3, 4)]) < 1e-12


def test_regrid_keeps_a_plane_and_skips_unknown_cells(spark, grid_of, dense):
    frame, target = Grid.of_shape(6, 6, 100.0), Grid(100.0, 100.0, 500.0, 500.0, 8, 8)
    plane = grid_of([[10 * r + c for c in range(6)] for r in range(6)], "value")
    from cellweave.grid import grid_cells

    got = dense(nb.regrid(plane, frame, target, grid_cells(spark, target)), "value")
    for (r, c), v in got.items():
        u, w = (100 + 50 * (c + 0.5)) / 100 - 0.5, (100 + 50 * (r + 0.5)) / 100 - 0.5
        assert abs(v - (10 * w + u)) < 1e-9
    holed = plane.withColumn("value", F.when((F.col("row") != 2) | (F.col("col") != 2), F.col("value")))
    assert all(v is not None for v in dense(nb.regrid(holed, frame, target, grid_cells(spark, target)), "value").values())
    assert nb.regrid(plane, frame, frame, plane).columns == ["row", "col", "value"]
