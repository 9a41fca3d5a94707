"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL (unlike `least`/`greatest` alone)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sigmoid_clipped(x: Column, bound: float = 30.0) -> Column:
    """Logistic function of a logit clamped to +-bound."""
    return sigmoid(clip(x, -bound, bound))


def linspace_values(start: float, stop: float, n: int) -> list[float]:
    """`n` evenly spaced numbers, both ends included, as driver-side floats."""
    if n == 1:
        return [float(start)]
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [float(stop)]


def linspace(start: float, stop: float, n: int) -> Column:
    """`n` evenly spaced numbers as an ARRAY<DOUBLE> column."""
    step = (stop - start) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * F.lit(step))


def within(distance: Column, threshold: float) -> Column:
    """True where the distance is known and at most `threshold`."""
    return F.coalesce(distance <= threshold, F.lit(False))


def all_present(columns: Sequence[str]) -> Column:
    """True where every listed column is non-null."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition


def threshold_bucket(x: Column, thresholds: Sequence[float]) -> Column:
    """How many of the (ascending) thresholds are <= x: 0..len(thresholds)."""
    total = F.lit(0)
    for t in thresholds:
        total = total + (x >= F.lit(float(t))).cast("int")
    return total


def linear_bucket(x: Column, start: float, stop: float, n: int) -> Column:
    """`threshold_bucket` for `linspace(start, stop, n)` in constant time per row.

    The division only guesses the bucket; comparing with the two neighbouring thresholds
    makes it exact at the edges.
    """
    step = (stop - start) / (n - 1)
    guess = F.least(F.greatest(F.floor((x - start) / step), F.lit(-1)), F.lit(n - 1))

    def threshold(i: Column) -> Column:
        return F.when(i >= n - 1, F.lit(float(stop))).otherwise(F.lit(float(start)) + i * F.lit(step))

    up = ((guess < n - 1) & (x >= threshold(guess + 1))).cast("int")
    down = ((guess >= 0) & (x < threshold(guess))).cast("int")
    return guess + 1 + up - down


def guarded_ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(default))
