"""Leading singular directions of a wide table of grid lines, by passes over strips of lines.

One method for every width: a randomised block spans the row space, each pass multiplies the newest block
by A'A and adds what is new to the basis, and Rayleigh-Ritz picks the leading directions until their
residuals are at rounding level. A tree of QR factors over the strips then settles the directions from A
itself, so small singular values do not suffer from the squared condition of A'A.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.lines import STRIP_CELLS
from cellweave.session import stored

#: Columns that the random block has beyond the wanted rank.
OVERSAMPLE = 8
#: The basis is folded to its best two blocks when it would pass this many.
BLOCKS = 12
#: A pass hands on its sums in pieces of about so many numbers, one reducer each.
PIECE = 1 << 16
#: QR factors that reach the driver, each block x block.
FACTORS = 32


def packed_strips(cells: DataFrame, value: str, width: int, fill: float) -> DataFrame:
    """`strip, plane`: strips of whole lines as dense doubles, nulls and absent cells filled; written once."""

    def pack(strip: pd.DataFrame) -> pd.DataFrame:
        lines, index = np.unique(strip["row"].to_numpy(), return_inverse=True)
        plane = np.full((len(lines), width), fill)
        known = strip["v"].to_numpy(dtype="float64", na_value=np.nan)
        plane[index, strip["col"].to_numpy()] = np.where(np.isnan(known), fill, known)
        return pd.DataFrame({"strip": strip["strip"].iloc[:1].to_numpy(), "plane": [plane.tobytes()]})

    per_strip = max(1, STRIP_CELLS // width)
    typed = cells.select("row", "col", F.col(value).cast("double").alias("v"), F.floor(F.col("row") / per_strip).alias("strip"))
    return stored(typed.groupBy("strip").applyInPandas(pack, "strip bigint, plane binary"), "strips")


def _planes(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for strip, plane in zip(batch["strip"], batch["plane"]):
            yield int(strip), np.frombuffer(plane, dtype=np.float64).reshape(-1, width)


def gram_product(strips: DataFrame, width: int, block: np.ndarray) -> np.ndarray:
    """A'A times `block` (width x k): each task adds up its strips, and the sums are added piece by piece."""
    k = block.shape[1]
    step = max(1, PIECE // k)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, k))
        seen = False
        for _, plane in _planes(batches, width):
            total += plane.T @ (plane @ block)
            seen = True
        if seen:
            for at in range(0, width, step):
                yield pd.DataFrame({"at": [at], "part": [total[at : at + step].tobytes()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, dtype=np.float64) for p in parts["part"])
        return pd.DataFrame({"at": parts["at"].iloc[:1].to_numpy(), "part": [total.tobytes()]})

    schema = "at bigint, part binary"
    out = np.zeros((width, k))
    for piece in strips.mapInPandas(multiply, schema).groupBy("at").applyInPandas(add, schema).collect():
        out[piece["at"] : piece["at"] + step] = np.frombuffer(piece["part"], dtype=np.float64).reshape(-1, k)
    return out


def triangular_factor(strips: DataFrame, width: int, block: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of A times `block`: factors of tasks are stacked and factored again, in a tree."""
    k = block.shape[1]

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, first = np.zeros((0, k)), 0
        for strip, plane in _planes(batches, width):
            r, first = np.linalg.qr(np.vstack([r, plane @ block]), "r"), strip
        if len(r):
            yield pd.DataFrame({"node": [first % FACTORS], "r": [r.tobytes()]})

    def combine(parts: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, k))
        for part in parts["r"]:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(part, dtype=np.float64).reshape(-1, k)]), "r")
        return pd.DataFrame({"node": parts["node"].iloc[:1].to_numpy(), "r": [r.tobytes()]})

    schema = "node bigint, r binary"
    tree = strips.mapInPandas(factor, schema).groupBy("node").applyInPandas(combine, schema).collect()
    stacked = [np.frombuffer(t["r"], dtype=np.float64).reshape(-1, k) for t in tree]
    return np.linalg.qr(np.vstack(stacked), "r") if stacked else np.zeros((0, k))


def leading_directions(strips: DataFrame, width: int, rank: int, seed: int = 7, tolerance: float = 1e-12, passes: int = 300) -> np.ndarray:
    """The `rank` leading right singular vectors (width x rank; fewer where the rows have a lower rank).

    The driver holds the basis, at most width x (rank + OVERSAMPLE) x BLOCKS numbers. Directions whose
    residuals stay above `tolerance` of the largest eigenvalue after `passes` passes are an error.
    """
    rank = min(rank, width)
    size = min(width, rank + OVERSAMPLE)
    if rank == 0:
        return np.zeros((width, 0))
    newest = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(passes):
        image = gram_product(strips, width, newest)
        basis, images = np.hstack([basis, newest]), np.hstack([images, image])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        gaps = np.linalg.norm(images @ vectors[:, :rank] - (basis @ vectors[:, :rank]) * values[:rank], axis=0)
        top = max(values[0], 0.0)
        if basis.shape[1] >= width or gaps.max() <= tolerance * top:
            break
        fresh = image - basis @ (basis.T @ image)
        left, spread, _ = np.linalg.svd(fresh - basis @ (basis.T @ fresh), full_matrices=False)
        left = left[:, spread > 1e-15 * top][:, : width - basis.shape[1]]
        if not left.shape[1]:
            break
        newest = np.linalg.qr(left - basis @ (basis.T @ left))[0]
        if basis.shape[1] + size > BLOCKS * size:  # the new block holds what all residuals point to, so the best two suffice
            basis, images = basis @ vectors[:, : 2 * size], images @ vectors[:, : 2 * size]
    else:
        raise ArithmeticError(f"{rank} directions did not settle in {passes} passes")
    found = basis @ vectors[:, :size]
    r = triangular_factor(strips, width, found)
    _, sizes, turned = np.linalg.svd(r, full_matrices=False)
    kept = turned[: min(rank, int((sizes > 0).sum()))]
    return np.linalg.qr(found @ kept.T)[0]
