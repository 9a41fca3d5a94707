"""Score maps for several depths: passes over tiles, spread over the cells, fused over the depths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.categories import DEPTHS
from cellweave.operators.models import ensemble_uncertainty
from cellweave.operators.tiles import depth_ensemble_mean, tile_overlap_mean
from cellweave.session import stored

Terms = tuple[Sequence[float], float]


def depth_maps(
    tiles: DataFrame, features: Sequence[str], ensembles: Mapping[str, Sequence[Terms]], height: int, width: int, patch: int, stride: int
) -> DataFrame:
    """`row, col, n_tiles, mean_<depth>, std_<depth>, ..., fused` for every cell of the grid.

    `tiles` has a row per tile (`row, col` is its centre) with its features; `ensembles` holds the members of each
    depth as (weights, bias).  Each member is one pass; mean and deviation over the passes of a tile are
    averaged over the tiles that cover a cell, and `fused` is the mean over the depths.  Cells without a
    tile have no values.  All depths are scored in one scan of the tiles and spread in one accumulation.
    """
    depths = [d for d in DEPTHS if d in ensembles] + [d for d in ensembles if d not in DEPTHS]
    scored = stored(tiles.select("row", "col", *features), "depth-tiles")
    table = scored
    for depth in depths:
        members = [[bias, *weights] for weights, bias in ensembles[depth]]
        one = ensemble_uncertainty(table, features, members, table.columns)
        table = one.withColumnsRenamed({"mean": f"mean_{depth}", "std": f"std_{depth}"})
    columns = [f"{kind}_{depth}" for depth in depths for kind in ("mean", "std")]
    spread = tile_overlap_mean(table, columns, height, width, patch, stride)
    return spread.withColumn("fused", depth_ensemble_mean([f"mean_{depth}" for depth in depths]))


def report_table(scores: DataFrame, documents: DataFrame, path: str, sheet, limit: int = 50, doc: str = "doc_id") -> DataFrame:
    """`rank, score, filename, path, categories, toposheet` of the best documents."""
    from cellweave.operators.search import rank_reports

    best = F.broadcast(rank_reports(scores, limit, doc))  # at most `limit` rows
    named = documents.select(doc, F.col(path).alias("path"), sheet.alias("toposheet")).join(best, doc)
    return named.select("rank", "score", F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "categories", "toposheet")
