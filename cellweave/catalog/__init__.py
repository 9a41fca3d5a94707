"""Named queries over the sample tables, each with an independent SQL form where one exists."""

from cellweave.catalog import geometry, grids, metrics, models, normalise, roundtrips, sources, text, tiles  # noqa: F401
from cellweave.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
