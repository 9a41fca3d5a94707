"""Mixing sources by temperature: weights that meet an entropy or repetition target, realised in token budgets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm.common import with_identity
from cellweave.session import stored

STEP = 32  # exponents tried in one pass over the sources


@dataclass(frozen=True)
class Mixture:
    """The exponent found, the tokens to emit, and a table `source, docs, tokens, weight, budget, repeats`."""

    exponent: float
    budget: float
    sources: DataFrame


def word_count(text: Column) -> Column:
    """Tokens of a text for mixing: its runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _curve(sources: DataFrame, low: float, high: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest ratio of weight to share) at equal steps of [low, high]."""
    tries = [low + (high - low) * k / STEP for k in range(STEP + 1)]
    rows = sources.where("share > 0").select("share", F.explode(F.array(*[F.lit(x) for x in tries])).alias("x"))
    power = F.pow("share", F.col("x"))
    sums = rows.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max(power / F.col("share")).alias("r"))
    found = sums.select("x", (F.log("z") - F.col("x") * F.col("l") / F.col("z")).alias("h"), (F.col("r") / F.col("z")).alias("r")).collect()
    return sorted((r["x"], r["h"], r["r"]) for r in found)


def _bisect(sources: DataFrame, fits) -> float:
    """Largest exponent in [0, 1] that `fits`, which holds up to some exponent; 0 if none does."""
    low, high = 0.0, 1.0
    for _ in range(6):
        curve = _curve(sources, low, high)
        good = [x for x, h, r in curve if fits(h, r)]
        if not curve or len(good) == len(curve):
            return high
        if not good:
            return low
        low, high = good[-1], good[-1] + (high - low) / STEP
    return low


def temperature_weights(
    docs: DataFrame, entropy: float | None = 0.9, repeats: float = 4.0, budget: float | None = None, shrink: bool = False
) -> Mixture:
    """Weights proportional to share ** exponent, from a table (`source`, `tokens`).

    The exponent in [0, 1] is bisected (32 midpoints in each pass over the sources): the largest one whose
    weights reach `entropy` (a part of the largest possible entropy, the logarithm of the number of sources), but
    never one at which a source would be repeated more than `repeats` times within the budget; the
    repetition limit wins. `budget` is in tokens, by default all tokens. If budget and limit can't both hold
    even at exponent 1, the budget is lowered to what they allow. With `shrink` the entropy wins: the budget is
    lowered until no source is repeated more than `repeats` times.
    """
    totals = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    totals = stored(totals, "sources")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(max(all_tokens, 1)))
    sources = totals.withColumn("share", share)
    n = sources.where("tokens > 0").count()
    size = float(all_tokens if budget is None else budget)
    exponent = 1.0
    if n > 1:
        if entropy is not None:
            goal = entropy * math.log(n)
            exponent = _bisect(sources, lambda h, r: h >= goal)
        allowed = repeats * all_tokens / size if size else math.inf
        if shrink:
            pass
        elif allowed >= 1:
            exponent = max(exponent, _least(sources, lambda h, r: r <= allowed))
        else:
            exponent = 1.0
    size = min(size, repeats * all_tokens)
    z = sources.where("share > 0").agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    sources = sources.withColumn("weight", weight)
    if shrink:
        most = sources.where("weight > 0").agg(F.min(F.col("tokens") / F.col("weight"))).first()[0]
        size = min(size, repeats * (most or 0.0))
    sources = sources.withColumn("budget", F.round(F.col("weight") * F.lit(size), 3))
    sources = sources.withColumn("repeats", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(0.0))
    return Mixture(exponent, size, sources.select("source", "docs", "tokens", "weight", "budget", "repeats"))


def _least(sources: DataFrame, fits) -> float:
    """Smallest exponent in [0, 1] that `fits`, which holds from some exponent on; 1 if none does."""
    low, high = 0.0, 1.0
    for _ in range(6):
        curve = _curve(sources, low, high)
        good = [x for x, h, r in curve if fits(h, r)]
        if len(good) == len(curve):
            return low
        if not good:
            return high
        low, high = good[0] - (high - low) / STEP, good[0]
    return high


def realise(docs: DataFrame, mixture: Mixture, block_docs: int = 2000, seed: int = 1) -> DataFrame:
    """Emit documents (`doc_id`, `source`, `tokens`, `_r1`, `_r2`) by the budgets of a mixture.

    Each source is dealt into hashed blocks of about `block_docs` documents. In every epoch the blocks are
    permuted, and the documents within each block; running totals over blocks, and within a block over its
    documents, place every document in its source's token stream. Whole epochs take every document; in the
    last one the document that reaches the budget is the last, so a source emits its budget and less than one
    document more. Columns added: epoch, block, block_rank, rank (in the block), start (tokens of the source
    emitted before).
    """
    s = mixture.sources.select(F.col("source").alias("s_source"), F.col("docs").alias("s_docs"), F.col("tokens").alias("s_tokens"), F.col("budget").alias("s_budget"))
    epochs = F.when(F.col("s_tokens") > 0, F.greatest(F.ceil(F.col("s_budget") / F.col("s_tokens")), F.lit(1))).otherwise(1)
    s = s.withColumns({"epochs": epochs.cast("int"), "blocks": F.ceil(F.col("s_docs") / block_docs).cast("int")})
    rows = docs.join(s, docs["source"].eqNullSafe(s["s_source"]))
    spread = F.xxhash64(F.lit(seed), "doc_id", "_r1", "_r2")
    rows = rows.withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    blocks = rows.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("b_tokens"))
    order = W.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "source", "epoch", "block"), "block")
    before = F.coalesce(F.sum("b_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("epoch").alias("b_epoch"), F.col("block").alias("b_block"), F.row_number().over(order).alias("block_rank"), before.alias("b_start"))
    inside = W.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "doc_id", "_r1", "_r2"), "doc_id", "_r1", "_r2")
    upto = F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"rank": F.row_number().over(inside), "upto": upto})
    placed = rows.join(blocks, rows["source"].eqNullSafe(blocks["b_source"]) & (F.col("epoch") == F.col("b_epoch")) & (F.col("block") == F.col("b_block")))
    start = F.col("epoch") * F.col("s_tokens") + F.col("b_start") + F.col("upto") - F.col("tokens")
    whole = (F.col("epoch") + 1) * F.col("s_tokens") <= F.col("s_budget") + F.lit(0.5)
    taken = placed.where(whole | (start < F.col("s_budget") - F.lit(0.5)) | (F.col("s_tokens") == 0))
    return taken.select(*docs.columns, "epoch", "block", "block_rank", "rank", start.cast("long").alias("start"))


def mix(
    docs: DataFrame, entropy: float | None = 0.9, repeats: float = 4.0, budget: float | None = None, shrink: bool = False, block_docs: int = 2000, seed: int = 1
) -> tuple[DataFrame, Mixture]:
    """Choose temperature weights for the sources of `docs` (`doc_id`, `source`, `text`) and emit their documents.

    Returns the emitted documents (doc_id, source, tokens, _r1, _r2, epoch, block, block_rank, rank, start) and the
    mixture. A document appears once for every epoch that takes it. Within a source, the order is epoch,
    block_rank, rank.

    Tokens are runs of non-blank characters. Null and empty texts have none: they are emitted with the rows
    around them and change no share. Null sources form a source of their own. A source without any token has
    weight 0 and its documents appear once. Null and repeated doc_ids are rows like others; an empty table
    gives no rows. Only DataFrame functions are used.
    """
    rows = with_identity(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")))
    rows = stored(rows.select("doc_id", "source", "_r1", "_r2", word_count(F.col("text")).alias("tokens")), "token-counts")
    mixture = temperature_weights(rows, entropy, repeats, budget, shrink)
    return realise(rows, mixture, block_docs, seed), mixture
