"""Rule-based categories: deposit types, layer types, sheets, tiers and channel groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered substring rules for the deposit type.
DEPOSIT_RULES = [
    ("gold", ["gold"]),
    ("iron", ["iron", "fe"]),
    ("chromite", ["chrom"]),
    ("polymetallic", ["poly", "copper", "cu", "zinc", "zn", "lead", "pb", "silver", "ag"]),
]
DEPOSIT_ORDER = ["gold", "iron", "chromite", "polymetallic"]

# Ordered keywords that decide how a vector layer is burned.
LAYER_RULES = [
    ("distance", ["fault", "fold", "shear", "dyke", "dike", "contact", "lineament"]),
    ("categorical", ["litholog", "litho", "geology", "rock", "formation"]),
    ("binary", ["mine", "quarry", "mineral", "occurrence"]),
]

# Map sheets of the study area, in search order.
SHEETS = ["57A", "57B", "57E", "57F", "57C", "57D"]

# Channel names in band order, and the groups they belong to.
CHANNELS = [
    "lithology_25k", "fault_dist_25k", "fold_dist_25k", "shear_dist_25k", "dyke_dist_25k",
    "lithology_50k", "fault_dist_50k", "fold_dist_50k",
    "tmi", "tmi_1vd", "tmi_asa", "tmi_tdr",
    "fault_density_kde", "structural_complexity", "contact_density",
]
CHANNEL_GROUPS = {
    "geological_25k": [0, 1, 2, 3, 4],
    "geological_50k": [5, 6, 7],
    "aeromagnetic": [8, 9, 10, 11],
    "derived": [12, 13, 14],
}
DEPTHS = ["0_500m", "500_1000m", "1000_2000m"]


def _first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    chain = F
    for label, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        chain = chain.when(hit, label)
    return chain.otherwise(F.lit(default))


def deposit_type(raw: Column) -> Column:
    """Canonical deposit type of a free-text type; unknown or missing text is `unknown`."""
    return _first_rule(F.trim(F.lower(raw)), DEPOSIT_RULES, "unknown")


def layer_type(name: Column) -> Column:
    """distance, categorical or binary, by the first keyword found in the layer name."""
    return _first_rule(F.lower(name), LAYER_RULES, "distance")


def map_sheet(path: Column, sheets: Sequence[str] = tuple(SHEETS)) -> Column:
    """First listed sheet code contained in the path, else `other`."""
    return _first_rule(F.upper(path), [(s, [s.upper()]) for s in sheets], "other")


def decision_tier(p: Column, u: Column, u_low: Column, p_high: float = 0.25, p_low: float = 0.10) -> Column:
    """Tiers 1-4 by score and uncertainty; scores between the two bounds have none."""
    return (
        F.when((p > p_high) & (u <= u_low), 1)
        .when((p > p_high) & (u > u_low), 2)
        .when((p <= p_low) & (u <= u_low), 3)
        .when((p <= p_low) & (u > u_low), 4)
    )


def group_bands(*groups: str) -> list[str]:
    """Band column names of the named channel groups."""
    return [f"b{i}" for g in groups for i in CHANNEL_GROUPS[g]]
