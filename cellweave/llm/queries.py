"""Queries of the corpus operators over the sample tables, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.chat import digest_chats, format_chats, records_of_turns
from cellweave.llm.chunks import encode_documents
from cellweave.llm.line_dedup import dedup_lines
from cellweave.llm.mixing import mix
from cellweave.llm.multi_index import nearest
from cellweave.llm.ngram_join import ngram_join
from cellweave.llm.packing import pack
from cellweave.llm.pq_dedup import near_duplicates
from cellweave.llm.quality import classify_quality
from cellweave.llm.repair import damaged, digest_repairs, repair_conversations
from cellweave.llm.token_counts import token_counts
from cellweave.llm.toxicity import fit_chain, score_toxicity
from cellweave.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


OP1_SQL = r"""
WITH RECURSIVE said AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
  grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM said WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (
    SELECT i, j FROM shared JOIN sizes s ON s.doc_id = i JOIN sizes t ON t.doc_id = j WHERE m >= 0.8 * (s.n + t.n - m)),
  reach(i, j) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j),
  classes AS (SELECT i AS doc_id, min(j) AS class_id FROM reach GROUP BY i),
  counts AS (SELECT i AS doc_id, count(*) AS n FROM links GROUP BY i)
SELECT d.doc_id, class_id, coalesce(n, 0) AS n_links, d.doc_id = class_id AS kept
FROM documents d JOIN classes USING (doc_id) LEFT JOIN counts ON counts.doc_id = d.doc_id
"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(read(spark, folder, "documents")).drop("_r1", "_r2")


@query("op2_mixing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    emitted, mixture = mix(read(spark, folder, "documents"))
    weights = mixture.sources.select(F.col("source").alias("of"), "weight")
    return emitted.join(weights, F.col("source").eqNullSafe(F.col("of"))).drop("of", "_r1", "_r2")


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


PROBE = r"\### Assistant: </turn> ok"

# The template's escapes in SQL: a backslash before each backslash, hash sign, `</`, and colon before a blank.
_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '#', '\#'), '</', '\</'), ': ', '\: ')"

OP5_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(14 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


@query("op5_chat_formatting", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest_chats(format_chats(records_of_turns(turns.unionByName(probe))))


@query("op6_line_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(read(spark, folder, "documents"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = classify_quality(read(spark, folder, "documents"))
    return judged.select("doc_id", "quality_posterior", "quality_score", "quality_keep")


OP8_SQL = """
WITH RECURSIVE fine AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS i, b.vec_id AS j FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  reach(i, j) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j),
  groups AS (SELECT i AS vec_id, min(j) AS component_id FROM reach GROUP BY i),
  counts AS (SELECT i AS vec_id, count(*) AS n FROM links GROUP BY i)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v JOIN groups USING (vec_id) LEFT JOIN counts ON counts.vec_id = v.vec_id
"""


@query("op8_embedding_near_dedup", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "embeddings"))


INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Categories in chain order: open insults, coded ones (toxic without an open insult), toxic at all."""
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    bad, open_ = F.col("toxic") == 1, F.lower("text").rlike(r"\b(" + "|".join(INSULTS) + r")\b")
    chain, _, _ = fit_chain(docs, labels, ["toxic"], {"insult": bad & open_, "coded": bad & ~open_, "toxic": bad})
    return score_toxicity(docs, chain, threshold=0.3)


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return digest_repairs(repair_conversations(damaged(turns), turns))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(read(spark, folder, "embeddings"))


@query("op12_bpe_chunks")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), figures=True).per_document()
