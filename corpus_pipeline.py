"""From raw documents to packed training sequences: five stages, each a table of its own."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellweave.llm.common import with_identity  # noqa: E402
from cellweave.llm.line_dedup import dedup_lines  # noqa: E402
from cellweave.llm.mixing import mix  # noqa: E402
from cellweave.llm.ngram_join import ngram_join  # noqa: E402
from cellweave.llm.packing import pack  # noqa: E402
from cellweave.llm.quality import classify_quality  # noqa: E402
from cellweave.session import stored  # noqa: E402

KEY = ["_i", "_z", "_r1", "_r2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Columns that name a document by id and text, without nulls."""
    return with_identity(docs).withColumns({"_i": F.coalesce(F.col("doc_id"), F.lit(0)), "_z": F.col("doc_id").isNull()})


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of `docs` named in `chosen` (doc_id, _r1, _r2). The text moves once; `chosen` is the side that is built."""
    chosen = chosen.select("doc_id", "_r1", "_r2").withColumns({"_i": F.coalesce(F.col("doc_id"), F.lit(0)), "_z": F.col("doc_id").isNull()})
    return _keyed(docs).join(chosen.select(*KEY).distinct().hint("shuffle_hash"), KEY, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return classify_quality(docs).where("quality_keep").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that repeat an earlier document go, and with them the documents that they leave empty."""
    left = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; of rows equal in id and text, one."""
    kept = ngram_join(docs).where("kept")
    return _only(docs, kept).dropDuplicates(KEY).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: the token budget holds, and small sources are repeated.

    The weights have 0.9 of the largest possible entropy, or the most that repeating no source more than four times
    allows. A large source gives up only the tokens that repetition adds to the others. Where the sources meet the
    entropy as they are, every document stays once. A document that is taken in several epochs has a row for each.
    """
    rows, plan = mix(docs, entropy=0.9, repeats=4.0)
    if plan.exponent == 1:
        return docs
    chosen = rows.withColumns({"_i": F.coalesce(F.col("doc_id"), F.lit(0)), "_z": F.col("doc_id").isNull()}).select(*KEY, "epoch").distinct()
    return _keyed(docs).join(chosen.hint("shuffle_hash"), KEY).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens in which every window holds the shares that the mixture has realised."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

ORACLE_SQL = None  # alignment, fitted models and tokenizers have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
