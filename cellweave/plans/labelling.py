"""From point and feature layers to labelled cells, spatial folds and their counts, as one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.grid import Grid
from cellweave.operators.geometry import buffer_label
from cellweave.operators.labels import fold_counts, fold_masks
from cellweave.session import stored
from cellweave.sources.inventory import write_manifest
from cellweave.sources.vectors import union_layers


@dataclass(frozen=True)
class Labelled:
    """Labels of all cells, the masks of every fold, and how many cells each mask holds."""

    labels: DataFrame
    masks: DataFrame
    counts: DataFrame

    def write(self, folder: str) -> None:
        """The three tables below one folder; counts as a manifest."""
        self.labels.write.mode("overwrite").parquet(f"{folder}/labels")
        self.masks.write.mode("overwrite").partitionBy("fold", "kind").parquet(f"{folder}/masks")
        write_manifest(self.counts, f"{folder}/counts")


def label_cells(
    layers: Mapping[str, DataFrame], cells: DataFrame, grid: Grid, strips: Sequence[dict[str, int]], radius: float = 500.0, occurrences: Sequence[str] = ()
) -> Labelled:
    """Occurrence points of all layers, buffered by `radius`, burnt into labels and cut into folds."""
    points = union_layers(dict(layers), occurrences)
    if points is None:
        raise ValueError("no occurrence layer among " + ", ".join(layers))
    spot = F.col("geom.parts")[0][0]
    points = points.select(spot["x"].alias("x"), spot["y"].alias("y"))
    labels = stored(buffer_label(cells, points, grid, radius), "labels")  # read by the masks and the counts
    return Labelled(labels, fold_masks(labels, strips), fold_counts(labels, strips))
