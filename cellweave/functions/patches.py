"""Expressions over patches stored as flat row-major arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reorder(patch: Column, order: list[int]) -> Column:
    """The patch with element k taken from `order[k]`."""
    index = F.array(*[F.lit(i) for i in order])
    return F.transform(index, lambda i: F.get(patch, i))


def rotate90(patch: Column, side: int, turns: int = 1) -> Column:
    """Counter-clockwise quarter turns of a side x side patch."""
    order = [r * side + c for r in range(side) for c in range(side)]
    for _ in range(turns % 4):
        order = [order[c * side + (side - 1 - r)] for r in range(side) for c in range(side)]
    return reorder(patch, order)


def flip_horizontal(patch: Column, side: int) -> Column:
    return reorder(patch, [r * side + (side - 1 - c) for r in range(side) for c in range(side)])


def flip_vertical(patch: Column, side: int) -> Column:
    return reorder(patch, [(side - 1 - r) * side + c for r in range(side) for c in range(side)])


def patchify(patch: Column, side: int, token: int, channels: int = 1) -> Column:
    """ARRAY of tokens in grid order, each flattened as (row, col, channel).

    `patch` holds `channels` planes one after another, each row-major.
    """
    grid = side // token
    tokens = []
    for gr in range(grid):
        for gc in range(grid):
            order = [
                ch * side * side + (gr * token + r) * side + gc * token + c
                for r in range(token)
                for c in range(token)
                for ch in range(channels)
            ]
            tokens.append(reorder(patch, order))
    return F.array(*tokens)


def add_noise(patch: Column, key: Column, sigma: float = 0.01, seed: int = 42) -> Column:
    """Gaussian noise of width sigma, then clamp to [0, 1]; `key` tells the rows apart, so equal patches differ.

    `randn` cannot vary inside a lambda, so the draw per element comes from two hashed
    uniforms of (row key, position) through the Box-Muller transform.
    """

    def noisy(x: Column, i: Column) -> Column:
        digits = F.md5(F.concat_ws("-", key, F.lit(seed), i))
        first = (F.conv(F.substring(digits, 1, 6), 16, 10).cast("double") + 0.5) / float(1 << 24)
        second = F.conv(F.substring(digits, 7, 6), 16, 10).cast("double") / float(1 << 24)
        normal = F.sqrt(-2 * F.ln(first)) * F.cos(6.283185307179586 * second)
        return F.least(F.greatest(x + sigma * normal, F.lit(0.0)), F.lit(1.0))

    return F.transform(patch, noisy)


def token_error(pred: Column, target: Column) -> Column:
    """Mean squared difference of two equally long arrays."""
    squares = F.zip_with(pred, target, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(pred)
