"""Keyword search over report texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.scale import smallest_by_key, spread

# Search terms by category, in report order; terms are case-insensitive patterns.
SEARCH_TERMS: dict[str, list[str]] = {
    "deposit_cooccurrence": [
        "gold and chromite", "gold and iron", "chromite and gold",
        "polymetallic and gold", "associated with gold",
        "co-occurrence", "cooccurrence", "multiple deposit",
        "gold.*chromite", "chromite.*gold", "gold.*iron.*chromite",
    ],
    "greenstone_framework": [
        "greenstone belt", "schist belt", "dharwar",
        "chitradurga", "hutti", "sandur", "nuggihalli",
        "archean", "supracrustal", "banded iron formation", "bif",
        "ultramafic", "mafic-ultramafic",
    ],
    "structural_control": [
        "shear zone", "fault intersection", "structural control",
        "orogenic gold", "hydrothermal", "fluid conduit",
        "brittle-ductile", "mineralization controlled",
    ],
    "deposit_footprint": [
        "buffer", "zone of influence", "mineralized zone width",
        "strike length", "deposit dimension", "ore zone",
        "500 m", "500m", "mineralization extent",
    ],
    "metallogenic_episode": [
        "metallogenic", "mineralization episode", "tectono-magmatic",
        "late archean", "proterozoic", "2700 ma", "2500 ma",
    ],
}

CONTEXT = 200


def searchable(documents: DataFrame, text: str = "text", min_chars: int | None = None) -> DataFrame:
    """Lower-case the text; with `min_chars`, drop documents that are too short to judge."""
    lowered = documents.withColumn(text, F.lower(text))
    return lowered if min_chars is None else lowered.where(F.length(text) >= min_chars)


def _is_plain(term: str) -> bool:
    """A lower-case term without pattern characters; the searched text is lower-cased."""
    return bool(re.fullmatch(r"[a-z0-9 -]+", term))


def _pattern(term: str) -> str:
    """Case-insensitive pattern in which only a newline ends a line."""
    return term if _is_plain(term) else f"(?id){term}"


def _count(text: str, term: str) -> Column:
    """Non-overlapping occurrences; plain terms are counted on the bytes without a pattern engine."""
    if _is_plain(term):
        shorter = F.octet_length(F.replace(F.col(text), F.lit(term), F.lit("")))
        return ((F.octet_length(text) - shorter) / len(term)).cast("bigint")
    return F.regexp_count(F.col(text), F.lit(_pattern(term))).cast("bigint")


def term_hits(
    documents: DataFrame, terms: Mapping[str, Sequence[str]], doc: str = "doc_id", text: str = "text", min_chars: int | None = None
) -> DataFrame:
    """`doc, category, cat_ord, term, term_ord, hits`: terms found in each document.

    The term list is constant, so every text is read once and turned into a short array of
    counts; no document row is multiplied by terms and nothing is shuffled.
    """
    slots = [
        F.struct(
            F.lit(category).alias("category"),
            F.lit(i).cast("bigint").alias("cat_ord"),
            F.lit(term).alias("term"),
            F.lit(j).cast("bigint").alias("term_ord"),
            _count(text, term).alias("hits"),
        )
        for i, (category, words) in enumerate(terms.items())
        for j, term in enumerate(words)
    ]
    found = F.filter(F.array(*slots), lambda h: h["hits"] > 0)
    return searchable(documents, text, min_chars).select(doc, F.explode(found).alias("_h")).select(doc, "_h.*")


def document_scores(
    documents: DataFrame, terms: Mapping[str, Sequence[str]], doc: str = "doc_id", text: str = "text",
    per_term: int | None = None, min_chars: int | None = None,
) -> DataFrame:
    """`doc, score, categories`: hits of all terms, categories in list order.

    With `per_term`, a term adds at most that much to the score of a document.
    Computed inside the document row, so hot documents and hot terms make no difference.
    """
    per_category = []
    for category, words in terms.items():
        total = F.lit(0).cast("bigint")
        for term in words:
            hits = _count(text, term)
            total = total + (hits if per_term is None else F.least(hits, F.lit(per_term)))
        per_category.append(F.struct(F.lit(category).alias("category"), total.alias("score")))
    found = F.filter(F.array(*per_category), lambda c: c["score"] > 0)
    # Through a generator, because a filter on the score would otherwise be pushed below the
    # projection together with a second copy of every pattern.
    scored = searchable(documents, text, min_chars).select(doc, F.explode(F.array(found)).alias("_c"))
    score = F.aggregate("_c", F.lit(0).cast("bigint"), lambda s, c: s + c["score"])
    names = F.array_join(F.transform("_c", lambda c: c["category"]), "|")
    return scored.select(doc, score.alias("score"), names.alias("categories")).where(F.col("score") > 0)


def term_contexts(
    documents: DataFrame, terms: Mapping[str, Sequence[str]], doc: str = "doc_id", text: str = "text",
    per_term: int | None = None, min_chars: int | None = None,
) -> DataFrame:
    """`doc, category, term, term_ord, k, snippet`: snippets of +-200 characters around every hit.

    Plain terms are looked up in the text; of a pattern, the text is split at its matches, and the pieces and the matches
    between them give the positions.  Each text is read once and its snippets are cut by position, so the work of a text
    grows with its length and hits.  Only the finished snippets leave the document row.  With `per_term`, only the first
    matches count.
    """
    slots = [(category, i, term, j) for i, (category, words) in enumerate(terms.items()) for j, term in enumerate(words)]

    def spans(term: str) -> Column:
        """Lengths of the pieces and of the matches of a pattern; null for a plain term, which needs none."""
        if _is_plain(term):
            return F.lit(None).cast("array<array<int>>")
        body = F.col(text)
        pieces = F.split(body, _pattern(term), -1 if per_term is None else per_term + 1)
        matches = F.regexp_extract_all(body, F.lit(_pattern(term)), F.lit(0))
        matches = matches if per_term is None else F.slice(matches, 1, per_term)
        return F.array(F.transform(pieces, lambda p: F.length(p)), F.transform(matches, lambda m: F.length(m)))

    rows = spread(documents).where(F.col(text).isNotNull())
    texts = searchable(rows, text, min_chars).select(doc, text, F.array(*[spans(term) for _, _, term, _ in slots]).alias("_spans"))
    schema = T.StructType([documents.schema[doc], *T.StructType.fromDDL("_slot int, k long, snippet string").fields])
    plain = [term if _is_plain(term) else None for _, _, term, _ in slots]
    found = texts.mapInArrow(lambda batches: _contexts(batches, doc, text, plain, per_term), schema)
    table = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(i).cast("bigint").alias("cat_ord"), F.lit(t).alias("term"), F.lit(j).cast("bigint").alias("term_ord"))
        for c, i, t, j in slots
    ])
    return found.withColumn("_h", F.get(table, F.col("_slot"))).select(doc, "_h.category", "_h.cat_ord", "_h.term", "_h.term_ord", "k", "snippet")


def _matches(body: str, term: str | None, spans: Sequence[Sequence[int]] | None, most: int | None) -> Iterator[tuple[int, int]]:
    """Start and length of the matches that do not overlap, from the left."""
    if term is None:
        pieces, matches = spans
        at = 0
        for k, length in enumerate(matches):
            at += pieces[k] if k < len(pieces) else 0
            yield at, length
            at += length
        return
    at, k = body.find(term), 0
    while at >= 0 and (most is None or k < most):
        yield at, len(term)
        at, k = body.find(term, at + len(term)), k + 1


def _contexts(batches: Iterator[pa.RecordBatch], doc: str, text: str, plain: Sequence[str | None], most: int | None) -> Iterator[pa.RecordBatch]:
    """Snippets around the matches of every term in every text, some thousands at a time."""
    for batch in batches:
        keys = batch.column(doc)
        rows: list[tuple[int, int, int, str]] = []

        def cut(rows: list[tuple[int, int, int, str]], keys: pa.Array = keys) -> pa.RecordBatch:
            row, slot, k, snippet = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64())), pa.array(slot, pa.int32()), pa.array(k, pa.int64()), pa.array(snippet, pa.string())],
                names=[doc, "_slot", "k", "snippet"],
            )

        for i in range(batch.num_rows):
            body, spans = batch.column(text)[i].as_py(), batch.column("_spans")[i].as_py()
            for slot, term in enumerate(plain):
                for k, (at, length) in enumerate(_matches(body, term, spans[slot], most)):
                    rows.append((i, slot, k, body[max(at - CONTEXT, 0) : at + length + CONTEXT].replace("\n", " ").strip(" ")))
                    if len(rows) == 8192:
                        yield cut(rows)
                        rows = []
        if rows:
            yield cut(rows)


def search_hits(documents: DataFrame, terms: Mapping[str, Sequence[str]], doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`doc, hits MAP<category, ARRAY<STRUCT<term, contexts>>>`, the nested form of the contexts.

    The snippets are shuffled once, to their document, and nested there.
    """
    one = term_contexts(documents, terms, doc, text, **options)
    met = one.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("cat_ord", "term_ord", "k", "snippet"))).alias("_h"))

    def contexts(i: int, j: int) -> Column:
        own = F.filter("_h", lambda h: (h["cat_ord"] == i) & (h["term_ord"] == j))
        return F.transform(own, lambda h: h["snippet"])

    def nested(i: int, words: Sequence[str]) -> Column:
        every = F.array(*[F.struct(F.lit(term).alias("term"), contexts(i, j).alias("contexts")) for j, term in enumerate(words)])
        return F.filter(every, lambda t: F.size(t["contexts"]) > 0)

    entries = F.array(*[F.struct(F.lit(c).alias("category"), nested(i, words).alias("terms")) for i, (c, words) in enumerate(terms.items()) if words])
    return met.select(doc, F.map_from_entries(F.filter(entries, lambda e: F.size(e["terms"]) > 0)).alias("hits"))


def rank_reports(scores: DataFrame, limit: int = 50, doc: str = "doc_id") -> DataFrame:
    """The `limit` best documents by score, document order on ties, with their `rank`.

    Each task keeps its own best `limit` rows; only those meet, so the rank window over the
    result never sees more than `limit` rows.
    """
    best = scores.orderBy(F.desc("score"), doc).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), doc)).cast("bigint"))


def topk_reports(scores: DataFrame, limit: int = 10, first: str = "deposit_cooccurrence", fallback: str = "greenstone_framework", doc: str = "doc_id") -> DataFrame:
    """Best documents of one category, or of the fallback category when it has none."""
    categories = F.split("categories", r"\|")
    wanted = scores.where(F.array_contains(categories, first))
    if wanted.isEmpty():
        wanted = scores.where(F.array_contains(categories, fallback))
    return rank_reports(wanted, limit, doc)


def two_phase_scores(
    documents: DataFrame, terms: Mapping[str, Sequence[str]], sheet: Column, doc: str = "doc_id", text: str = "text",
    enough: int = 20, good: int = 3, others: int | None = None, **options,
) -> DataFrame:
    """Scores of documents on a listed sheet; further documents are searched only when fewer than
    `enough` listed ones score at least `good`: all of them, or the first `others` by document key.
    """
    marked = documents.withColumn("_listed", sheet != "other")
    listed = document_scores(marked.where("_listed"), terms, doc, text, **options)
    if listed.where(F.col("score") >= good).limit(enough).count() >= enough:
        return listed
    rest = marked.where(~F.col("_listed"))
    if others is not None:
        rest = smallest_by_key(rest.withColumn("_key", F.col(doc)), "_key", [doc], F.lit(others))
    return listed.unionByName(document_scores(rest, terms, doc, text, **options))
