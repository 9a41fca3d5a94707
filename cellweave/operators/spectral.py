"""Potential-field operators in the wavenumber domain, trend surfaces and low-rank filtering."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.grid import Grid
from cellweave.operators.lines import map_lines
from cellweave.operators.lowrank import leading_directions, packed_strips


def _forward(re: np.ndarray, im: np.ndarray):
    out = np.fft.fft(np.nan_to_num(re, nan=0.0) + 1j * np.nan_to_num(im, nan=0.0), axis=-1)
    return [out.real, out.imag]


def _inverse(*planes):
    result = []
    for re, im in zip(planes[0::2], planes[1::2]):
        out = np.fft.ifft(re + 1j * im, axis=-1)
        result += [out.real, out.imag]
    return result


def spectrum(cells: DataFrame, value: str, grid: Grid) -> DataFrame:
    """2-D discrete Fourier transform of a complete grid: `row, col, re, im` (NULL counts as 0).

    Row strips are transformed, then column strips; each costs one shuffle and a task holds
    one strip.
    """
    start = cells.select("row", "col", F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    along = map_lines(start, "row", grid.width, _forward, ["re", "im"], ["re", "im"])
    return map_lines(along, "col", grid.height, _forward, ["re", "im"], ["re", "im"])


def inverse_spectrum(spec: DataFrame, fields: Sequence[str], grid: Grid) -> DataFrame:
    """Inverse transform of several complex fields `<name>_re, <name>_im` at once; real parts."""
    names = [f"{f}_{p}" for f in fields for p in ("re", "im")]
    along = map_lines(spec, "col", grid.height, _inverse, names, names)
    back = map_lines(along, "row", grid.width, _inverse, names, names)
    return back.select("row", "col", *[F.col(f"{f}_re").alias(f) for f in fields])


def wavenumber(index: Column, n: int, spacing: float) -> Column:
    """Angular wavenumber of a transform bin."""
    signed = F.when(index < (n + 1) // 2, index).otherwise(index - n)
    return signed * (2 * math.pi / (n * spacing))


def with_wavenumbers(spec: DataFrame, grid: Grid, spacing: float | None = None) -> DataFrame:
    """Add `kx, ky, k`; the zero bin gets k = 1e-10."""
    dx = grid.xres if spacing is None else spacing
    kx, ky = wavenumber(F.col("col"), grid.width, dx), wavenumber(F.col("row"), grid.height, dx)
    radial = F.when((F.col("row") == 0) & (F.col("col") == 0), F.lit(1e-10)).otherwise(F.sqrt(F.col("kx") ** 2 + F.col("ky") ** 2))
    return spec.withColumn("kx", kx).withColumn("ky", ky).withColumn("k", radial)


def _scaled(name: str, factor: Column) -> list[Column]:
    return [(F.col("re") * factor).alias(f"{name}_re"), (F.col("im") * factor).alias(f"{name}_im")]


def _turned(name: str, factor: Column) -> list[Column]:
    """Multiplication by i * factor."""
    return [(-F.col("im") * factor).alias(f"{name}_re"), (F.col("re") * factor).alias(f"{name}_im")]


def derivatives(spec: DataFrame, grid: Grid, heights: Sequence[float] = (), spacing: float | None = None) -> DataFrame:
    """All spectral products from one spectrum: `row, col, dx, dy, dz, up_<h>...`."""
    waves = with_wavenumbers(spec, grid, spacing)
    columns = [*_turned("dx", F.col("kx")), *_turned("dy", F.col("ky")), *_scaled("dz", F.col("k"))]
    names = ["dx", "dy", "dz"]
    for h in heights:
        name = f"up_{int(h)}"
        columns += _scaled(name, F.exp(-F.col("k") * float(h)))
        names.append(name)
    return inverse_spectrum(waves.select("row", "col", *columns), names, grid)


def first_vertical_derivative() -> Column:
    return F.col("dz")


def analytic_signal() -> Column:
    return F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)


def tilt_derivative() -> Column:
    return F.atan2(F.col("dz"), F.greatest(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2), F.lit(1e-10)))


def where_known(products: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Put NULL back where the input of a transform was NULL."""
    names = [c for c in products.columns if c not in ("row", "col")]
    known = cells.select("row", "col", F.col(value).isNotNull().alias("_known"))
    joined = products.join(known, ["row", "col"])
    return joined.select("row", "col", *[F.when(F.col("_known"), F.col(n)).alias(n) for n in names])


def trend_terms(grid: Grid, degree: int = 3) -> list[Column]:
    """Products p_j(col) p_i(row), i + j <= degree, of the polynomials that are orthogonal on the places of an axis.

    Both axes are scaled to [-1, 1] and the polynomials follow by their three-term recurrence. On a complete
    grid the terms are orthogonal; on an incomplete one they are far less alike than monomials.
    """

    def axis(name: str, n: int) -> list[Column]:
        step = 2.0 / (n - 1) if n > 1 else 0.0
        x = F.col(name) * step - 1.0 if n > 1 else F.lit(0.0)
        out = [F.lit(1.0), x]
        for k in range(1, degree):
            back = max(k * k * (n * n - k * k), 0) / (4.0 * (4 * k * k - 1)) * step * step
            out.append(x * out[k] - F.lit(back) * out[k - 1])
        return out[: degree + 1]

    along, down = axis("col", grid.width), axis("row", grid.height)
    return [along[j] * down[i] for i in range(degree + 1) for j in range(degree + 1 - i)]


def trend_coefficients(cells: DataFrame, value: str, grid: Grid, degree: int = 3) -> list[float]:
    """Least-squares trend surface over the known cells.

    The normal equations are sums of products, gathered in one map-side-combined pass; only
    that fixed number of sums reaches the driver.
    """
    terms = trend_terms(grid, degree)
    n = len(terms)
    v = F.col(value).cast("double")
    named = cells.where(v.isNotNull()).select(*[t.alias(f"t{i}") for i, t in enumerate(terms)], v.alias("v"))
    gram = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    right = [F.sum(F.col(f"t{i}") * F.col("v")).alias(f"r{i}") for i in range(n)]
    sums = named.agg(*gram, *right).first()
    if sums["r0"] is None:
        return [0.0] * n
    matrix = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    size = np.sqrt(np.diag(matrix))
    scale = np.divide(1.0, size, out=np.zeros(n), where=size > 0)  # a term that vanishes on the grid gets no weight
    solution, *_ = np.linalg.lstsq(matrix * np.outer(scale, scale), scale * np.array([sums[f"r{i}"] for i in range(n)]), rcond=None)
    return [float(c) for c in solution * scale]


def trend_residual(cells: DataFrame, value: str, grid: Grid, degree: int = 3) -> DataFrame:
    """`row, col, regional, residual`; both NULL where the value is NULL."""
    surface = F.lit(0.0)
    for c, term in zip(trend_coefficients(cells, value, grid, degree), trend_terms(grid, degree)):
        surface = surface + F.lit(c) * term
    v = F.col(value).cast("double")
    return cells.select(
        "row", "col", F.when(v.isNotNull(), surface).alias("regional"), F.when(v.isNotNull(), v - surface).alias("residual")
    )


def svd_lowrank(cells: DataFrame, value: str, grid: Grid, rank: int | None = None) -> DataFrame:
    """`row, col, filtered`: the grid rebuilt from its largest singular values.

    NULL cells are filled with the mean for the decomposition and NULL again afterwards.
    `leading_directions` finds the leading right singular vectors V; the low-rank grid is
    A V V', so each strip of rows is projected on its own.  The driver only ever holds
    blocks of width x rank numbers, whatever the number of rows.
    """
    keep = min(50, min(grid.height, grid.width) // 2) if rank is None else rank
    width = grid.width
    mean = cells.agg(F.avg(value)).first()[0]
    fill = 0.0 if mean is None else float(mean)
    directions = leading_directions(packed_strips(cells, value, width, fill), width, keep)
    typed = cells.select("row", "col", F.col(value).cast("double").alias("v"))

    def project(plane: np.ndarray):
        full = np.where(np.isnan(plane), fill, plane)
        return [np.where(np.isnan(plane), np.nan, full @ directions @ directions.T)]

    return map_lines(typed, "row", width, project, ["v"], ["filtered"])
