import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.grid import Grid
from cellweave.operators import lowrank
from cellweave.operators import spectral as sp


def _wave(n=8):
    return [[math.cos(2 * math.pi * c / n) for c in range(n)] for _ in range(n)]


def test_transform_equals_numpy_and_inverts(spark, grid_of):
    rng = np.random.default_rng(3)
    field = rng.normal(size=(6, 9))
    grid = Grid.of_shape(6, 9)
    spec = sp.spectrum(grid_of(field.tolist()), "v", grid)
    expected = np.fft.fft2(field)
    for r in spec.collect():
        assert abs(complex(r["re"], r["im"]) - expected[r["row"], r["col"]]) < 1e-9
    back = sp.inverse_spectrum(spec.select("row", "col", F.col("re").alias("v_re"), F.col("im").alias("v_im")), ["v"], grid)
    assert all(abs(r["v"] - field[r["row"], r["col"]]) < 1e-12 for r in back.collect())


def test_vertical_derivative_of_a_wave_is_k_times_the_wave(spark, grid_of):
    grid, k = Grid.of_shape(8, 8), 2 * math.pi / (8 * 50)
    cells = grid_of(_wave())
    out = sp.derivatives(sp.spectrum(cells, "v", grid), grid, [500])
    for r in out.select("*", sp.analytic_signal().alias("asa")).collect():
        x = 2 * math.pi * r["col"] / 8
        assert abs(r["dz"] - k * math.cos(x)) < 1e-9
        assert abs(r["dx"] + k * math.sin(x)) < 1e-9
        assert abs(r["up_500"] - math.exp(-500 * k) * math.cos(x)) < 1e-9
        assert abs(r["asa"] - k) < 1e-9


def test_cubic_trend_is_recovered(spark, grid_of):
    grid = Grid.of_shape(8, 8)
    field = [[3 + 2 * c - r + 0.5 * r * c + 0.01 * c**3 for c in range(8)] for r in range(8)]
    field[2][5] = None
    out = sp.trend_residual(grid_of(field), "v", grid).collect()
    assert all(r["residual"] is None or abs(r["residual"]) < 1e-8 for r in out)
    assert sum(r["residual"] is None for r in out) == 1


def test_incomplete_cubic_trend_equals_least_squares(spark, grid_of):
    rng = np.random.default_rng(9)
    field = rng.normal(size=(9, 30)) * 1e3
    known = rng.random((9, 30)) < 0.2
    field[known & (np.arange(30) > 20)] = np.nan
    field[:, :6] = np.nan
    rows, cols = np.nonzero(~np.isnan(field))
    x, y = cols * 2 / 29 - 1, rows * 2 / 8 - 1
    design = np.stack([x**j * y**i for i in range(4) for j in range(4 - i)], 1)
    fitted = design @ np.linalg.lstsq(design, field[rows, cols], rcond=None)[0]
    expected = {(r, c): v for r, c, v in zip(rows, cols, fitted)}
    cells = grid_of([[None if np.isnan(v) else v for v in line] for line in field])
    for r in sp.trend_residual(cells, "v", Grid.of_shape(9, 30)).where("regional is not null").collect():
        assert abs(r["regional"] - expected.pop((r["row"], r["col"]))) < 1e-8
    assert not expected


def test_trend_of_one_line_and_of_nothing(spark, grid_of):
    out = sp.trend_residual(grid_of([[1.0, 3.0, 5.0, 7.0]]), "v", Grid.of_shape(1, 4)).collect()
    assert all(abs(r["residual"]) < 1e-9 for r in out)
    out = sp.trend_residual(grid_of([[None, None]]), "v", Grid.of_shape(1, 2)).collect()
    assert [(r["regional"], r["residual"]) for r in out] == [(None, None)] * 2


@pytest.mark.parametrize("height, width, rank, blocks", [(14, 8, 3, 12), (120, 70, 2, 12), (90, 160, 3, 3), (40, 30, 15, 12)])
def test_lowrank_equals_numpy(spark, grid_of, monkeypatch, height, width, rank, blocks):
    monkeypatch.setattr(lowrank, "BLOCKS", blocks)  # three blocks: the basis is folded on the way
    monkeypatch.setattr(lowrank, "STRIP_CELLS", 4 * width)
    rng = np.random.default_rng(5)
    field = rng.normal(size=(height, width)) * (0.93 ** np.arange(width)) + 5
    u, s, vt = np.linalg.svd(field, full_matrices=False)
    expected = (u[:, :rank] * s[:rank]) @ vt[:rank]
    got = sp.svd_lowrank(grid_of(field.tolist()), "v", Grid.of_shape(height, width), rank=rank).collect()
    assert max(abs(r["filtered"] - expected[r["row"], r["col"]]) for r in got) < 1e-7


def test_lowrank_beyond_the_rank_of_the_field_and_of_zeros(spark, grid_of):
    field = np.outer(np.arange(1.0, 9.0), np.ones(6))
    got = sp.svd_lowrank(grid_of(field.tolist()), "v", Grid.of_shape(8, 6), rank=4).collect()
    assert max(abs(r["filtered"] - field[r["row"], r["col"]]) for r in got) < 1e-9
    got = sp.svd_lowrank(grid_of([[0.0] * 3] * 4), "v", Grid.of_shape(4, 3), rank=2).collect()
    assert all(r["filtered"] == 0 for r in got)


def test_lowrank_keeps_unknown_cells(spark, grid_of, dense):
    got = dense(sp.svd_lowrank(grid_of([[1, 2, None], [2, 4, 6], [3, 6, 9], [4, 8, 12]]), "v", Grid.of_shape(4, 3), rank=1), "filtered")
    assert got[(0, 2)] is None and len(got) == 12
