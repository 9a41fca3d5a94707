"""Numeric kernels along whole grid lines.

Separable filters, the distance transform and the Fourier transform all work on one
complete row or column at a time.  Cells are grouped into strips of neighbouring lines;
a strip holds at most STRIP_CELLS cells (or a single line), whatever the size of the
grid, and becomes a dense array only inside its task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells one strip may hold; fixed, so the memory of a task does not grow with the grid.
STRIP_CELLS = 1 << 14


def map_lines(
    df: DataFrame,
    axis: str,
    length: int,
    kernel: Callable[..., Sequence[np.ndarray]],
    inputs: Sequence[str],
    outputs: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Apply `kernel` to strips of lines and give `row, col, keep..., outputs...`.

    `axis` names the line ("row": each line is a row of `length` columns).  The kernel gets
    one (lines x length) array per input, NaN where a cell is NULL or absent, and returns
    one such array per output.
    """
    other = "col" if axis == "row" else "row"
    per_strip = max(1, STRIP_CELLS // max(length, 1))
    inputs, outputs, keep = list(inputs), list(outputs), list(keep)

    def run(strip: pd.DataFrame) -> pd.DataFrame:
        line = strip[axis].to_numpy() - int(strip[axis].min())
        place = strip[other].to_numpy()
        planes = []
        for name in inputs:
            plane = np.full((int(line.max()) + 1, length), np.nan)
            plane[line, place] = strip[name].to_numpy(dtype="float64", na_value=np.nan)
            planes.append(plane)
        result = {"row": strip["row"], "col": strip["col"], **{k: strip[k] for k in keep}}
        for name, plane in zip(outputs, kernel(*planes)):
            result[name] = plane[line, place]
        return pd.DataFrame(result)

    types = dict(df.dtypes)
    schema = ", ".join(
        ["row bigint", "col bigint"] + [f"`{k}` {types[k]}" for k in keep] + [f"`{name}` double" for name in outputs]
    )
    columns = ["row", "col", *dict.fromkeys([*keep, *inputs])]
    strips = df.select(*columns).withColumn("_strip", F.floor(F.col(axis) / per_strip))
    return strips.groupBy("_strip").applyInPandas(run, schema)


def reflected(plane: np.ndarray, margin: int) -> np.ndarray:
    """Pad the last axis by mirroring with the edge cell repeated."""
    n = plane.shape[-1]
    index = np.arange(-margin, n + margin) % (2 * n)
    return plane[..., np.where(index < n, index, 2 * n - 1 - index)]


def filter_lines(plane: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Symmetric FIR filter along the last axis with a reflected boundary; NaN counts as 0."""
    margin = len(weights) // 2
    padded = reflected(np.nan_to_num(plane, nan=0.0), margin)
    n = plane.shape[-1]
    out = weights[margin] * padded[..., margin : margin + n]
    for k in range(1, margin + 1):
        out += weights[margin + k] * (padded[..., margin - k : margin - k + n] + padded[..., margin + k : margin + k + n])
    return out


def squared_distance_lines(gap: np.ndarray) -> np.ndarray:
    """For each place, min over sites of (place - site)^2 + gap[site]^2; NaN gap = no site.

    The best site never moves left as the place moves right, so places are settled in
    halving strides, each between the answers of its settled neighbours: O(n log n),
    all lines of the strip at once.
    """
    lines, n = gap.shape
    line_of, site_at = np.nonzero(~np.isnan(gap))
    weight = gap[line_of, site_at] ** 2
    count = np.bincount(line_of, minlength=lines)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    out = np.full((lines, n), np.nan)
    live = np.flatnonzero(count)
    if not len(live):
        return out
    best = np.zeros((lines, n), dtype=np.int64)
    stride = 1
    while stride < n:
        stride *= 2
    while stride >= 1:
        places = np.arange(stride - 1, n, 2 * stride)
        if len(places):
            rows = np.repeat(live, len(places))
            cols = np.tile(places, len(live))
            left, right = cols - stride, cols + stride
            low = np.where(left >= 0, best[rows, np.maximum(left, 0)], 0)
            high = np.where(right < n, best[rows, np.minimum(right, n - 1)], count[rows] - 1)
            span = high - low + 1
            first = np.concatenate([[0], np.cumsum(span)[:-1]])
            query = np.repeat(np.arange(len(rows)), span)
            site = np.arange(span.sum()) - first[query] + low[query]
            at = start[rows[query]] + site
            cost = (cols[query] - site_at[at]) ** 2 + weight[at]
            least = np.minimum.reduceat(cost, first)
            hits = np.flatnonzero(cost == least[query])
            leading = np.concatenate([[True], query[hits][1:] != query[hits][:-1]])
            best[rows, cols] = site[hits[leading]]
            out[rows, cols] = least
        stride //= 2
    return out
