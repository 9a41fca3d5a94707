"""Queries: keyword search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.catalog import fixtures as fx
from cellweave.catalog.registry import query
from cellweave.functions.categories import map_sheet
from cellweave.operators import search, textindex
from cellweave.plans.maps import report_table
from cellweave.session import scratch_path

TERMS = fx.DOC_TERMS
PER_TERM = 3  # what one term may add to a score
_ROWS = ", ".join(
    f"({i}, '{category}', {j}, '{term}')" for i, (category, words) in enumerate(TERMS.items()) for j, term in enumerate(words)
)
SEARCH_SQL = f"""terms(cat_ord, category, term_ord, term) AS (VALUES {_ROWS}),
  docs AS (SELECT doc_id, lower(text) AS text, source FROM documents),
  hits AS (
    SELECT doc_id, category, CAST(cat_ord AS BIGINT) AS cat_ord, term, CAST(term_ord AS BIGINT) AS term_ord,
           CAST(len(regexp_extract_all(text, '(?i)' || term)) AS BIGINT) AS hits FROM docs, terms),
  found AS (SELECT * FROM hits WHERE hits > 0),
  scores AS (
    SELECT doc_id, CAST(sum(least(hits, 3)) AS BIGINT) AS score FROM found GROUP BY doc_id),
  cats AS (SELECT doc_id, string_agg(category, '|' ORDER BY cat_ord) AS categories FROM (SELECT DISTINCT doc_id, category, cat_ord FROM found) GROUP BY doc_id),
  scored AS (SELECT s.doc_id, score, categories FROM scores s JOIN cats USING (doc_id))"""


@query("j11_docs_x_terms", f"WITH {SEARCH_SQL} SELECT doc_id, category, cat_ord, term, term_ord, hits FROM found")
def j11(spark, folder):
    return search.term_hits(fx.docs(spark, folder), TERMS)


@query("a32_doc_score", f"WITH {SEARCH_SQL} SELECT doc_id, score, categories FROM scored")
def a32(spark, folder):
    return search.document_scores(fx.docs(spark, folder), TERMS, per_term=PER_TERM)


#: Positions of plain terms by repeated search from the last hit on.
_PLAIN = {c: [t for t in words if ".*" not in t] for c, words in TERMS.items()}
_PLAIN_ROWS = ", ".join(f"({j}, '{c}', '{t}')" for c, words in _PLAIN.items() for j, t in enumerate(words))
CONTEXT_SQL = f"""RECURSIVE terms(term_ord, category, term) AS (VALUES {_PLAIN_ROWS}),
  docs AS (SELECT doc_id, lower(text) AS text FROM documents),
  walk AS (
    SELECT doc_id, category, term, term_ord, 0 AS k, strpos(text, term) - 1 AS at_pos FROM docs, terms WHERE strpos(text, term) > 0
    UNION ALL
    SELECT w.doc_id, w.category, w.term, w.term_ord, w.k + 1, w.at_pos + length(w.term) + strpos(substr(text, w.at_pos + length(w.term) + 1), w.term) - 1
    FROM walk w JOIN docs USING (doc_id) WHERE strpos(substr(text, w.at_pos + length(w.term) + 1), w.term) > 0)"""


@query(
    "f3_term_contexts",
    f"""WITH {CONTEXT_SQL}
    SELECT doc_id, category, term, CAST(term_ord AS BIGINT) AS term_ord, CAST(k AS BIGINT) AS k,
           trim(replace(substr(text, greatest(at_pos - 200, 0) + 1, at_pos + length(term) + 200 - greatest(at_pos - 200, 0)), chr(10), ' '), ' ') AS snippet
    FROM walk JOIN docs USING (doc_id)""",
)
def f3(spark, folder):
    return search.term_contexts(fx.docs(spark, folder), _PLAIN).select("doc_id", "category", "term", "term_ord", "k", "snippet")


@query(
    "s19_search_hits",
    f"""WITH {CONTEXT_SQL} SELECT doc_id, category, term, count(*) AS n_contexts,
           min_by(trim(replace(substr(text, greatest(at_pos - 200, 0) + 1, at_pos + length(term) + 200 - greatest(at_pos - 200, 0)), chr(10), ' '), ' '), k) AS first
    FROM walk JOIN docs USING (doc_id) GROUP BY doc_id, category, term""",
)
def hits(spark, folder):
    """The nested hits of every document, opened again."""
    return _opened(search.search_hits(fx.docs(spark, folder), _PLAIN))


def _opened(nested: DataFrame) -> DataFrame:
    terms = nested.select("doc_id", F.explode("hits").alias("category", "terms")).select("doc_id", "category", F.inline("terms"))
    return terms.select("doc_id", "category", "term", F.size("contexts").cast("bigint").alias("n_contexts"), F.get("contexts", F.lit(0)).alias("first"))


#: The same walk for patterns, too. The next match is the first place of its own text: an earlier place would match before.
_ALL_SQL = f"""RECURSIVE {SEARCH_SQL.split(" AS (VALUES")[0]} AS (VALUES {_ROWS}),
  docs AS (SELECT doc_id, lower(text) AS text FROM documents),
  walk AS (
    SELECT doc_id, category, term, term_ord, 0 AS k, strpos(text, hit) - 1 AS at_pos, hit
    FROM (SELECT *, regexp_extract(text, term) AS hit FROM docs, terms WHERE regexp_matches(text, term))
    UNION ALL
    SELECT doc_id, category, term, term_ord, k + 1, at_pos + length(last) + strpos(rest, hit) - 1, hit
    FROM (SELECT *, regexp_extract(rest, term) AS hit
          FROM (SELECT w.doc_id, category, term, term_ord, k, at_pos, hit AS last, substr(text, at_pos + length(hit) + 1) AS rest FROM walk w JOIN docs USING (doc_id)) AS left_over
          WHERE regexp_matches(rest, term)) AS next_hit),
  contexts AS (
    SELECT doc_id, category, term, CAST(term_ord AS BIGINT) AS term_ord, CAST(k AS BIGINT) AS k,
           trim(replace(substr(text, greatest(at_pos - 200, 0) + 1, at_pos + length(hit) + 200 - greatest(at_pos - 200, 0)), chr(10), ' '), ' ') AS snippet
    FROM walk JOIN docs USING (doc_id))"""


@query("f3_term_contexts_all", f"WITH {_ALL_SQL} SELECT * FROM contexts")
def f3_all(spark, folder):
    """Contexts of all terms, the pattern included."""
    return search.term_contexts(fx.docs(spark, folder), TERMS).select("doc_id", "category", "term", "term_ord", "k", "snippet")


@query(
    "s19_search_hits_all",
    f"WITH {_ALL_SQL} SELECT doc_id, category, term, count(*) AS n_contexts, min_by(snippet, k) AS first FROM contexts GROUP BY doc_id, category, term",
)
def hits_all(spark, folder):
    """The nested hits of all terms, the pattern included."""
    return _opened(search.search_hits(fx.docs(spark, folder), TERMS))


def _index(spark, folder):
    """Postings of all documents, written once a session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _WRITTEN:
        path = scratch_path(spark, "postings")
        textindex.write_index(fx.docs(spark, folder), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


_WRITTEN: dict[tuple[str, str], str] = {}


@query("j11_indexed_hits", f"WITH {SEARCH_SQL} SELECT doc_id, category, cat_ord, term, term_ord, hits FROM found")
def j11_indexed(spark, folder):
    """Hits of all terms from the postings; texts are read for the pattern only, where its parts occur."""
    return textindex.indexed_hits(spark, _index(spark, folder), fx.docs(spark, folder), TERMS)


@query("a32_indexed_score", f"WITH {SEARCH_SQL} SELECT doc_id, score, categories FROM scored")
def a32_indexed(spark, folder):
    return textindex.indexed_scores(spark, _index(spark, folder), fx.docs(spark, folder), TERMS, per_term=PER_TERM)


@query("f3_indexed_contexts", f"WITH {_ALL_SQL} SELECT * FROM contexts")
def f3_indexed(spark, folder):
    found = textindex.indexed_contexts(spark, _index(spark, folder), fx.docs(spark, folder), TERMS)
    return found.select("doc_id", "category", "term", "term_ord", "k", "snippet")


@query(
    "w7_report_table",
    f"""WITH {SEARCH_SQL}, best AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT rank, score, doc_id || '.txt' AS filename, 'reports/' || source || '/' || doc_id || '.txt' AS path, categories,
      CASE WHEN upper(source) LIKE '%SRC3%' THEN 'SRC3' WHEN upper(source) LIKE '%SRC7%' THEN 'SRC7' WHEN upper(source) LIKE '%SRC1%' THEN 'SRC1' ELSE 'other' END AS toposheet
    FROM best JOIN documents USING (doc_id) WHERE rank <= 50""",
)
def report(spark, folder):
    docs = fx.docs(spark, folder)
    placed = docs.withColumn("file", F.concat(F.lit("reports/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    scores = search.document_scores(docs, TERMS, per_term=PER_TERM)
    return report_table(scores, placed, "file", map_sheet(F.col("source"), fx.DOC_SHEETS))


@query(
    "c13_toposheet",
    "SELECT doc_id, CASE WHEN upper(source) LIKE '%SRC3%' THEN 'SRC3' WHEN upper(source) LIKE '%SRC7%' THEN 'SRC7' WHEN upper(source) LIKE '%SRC1%' THEN 'SRC1' ELSE 'other' END AS sheet FROM documents",
)
def c13(spark, folder):
    return fx.docs(spark, folder).select("doc_id", map_sheet(F.col("source"), fx.DOC_SHEETS).alias("sheet"))


_RANKED = "SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score, categories FROM"


@query("w7_rank_reports", f"WITH {SEARCH_SQL} SELECT * FROM ({_RANKED} scored) WHERE rank <= 30")
def w7(spark, folder):
    return search.rank_reports(search.document_scores(fx.docs(spark, folder), TERMS, per_term=PER_TERM), 30)


@query(
    "t1_topk_reports",
    f"WITH {SEARCH_SQL} SELECT * FROM ({_RANKED} scored WHERE list_contains(string_split(categories, '|'), 'german')) WHERE rank <= 10",
)
def t1(spark, folder):
    return search.topk_reports(search.document_scores(fx.docs(spark, folder), TERMS, per_term=PER_TERM), 10, "absent", "german")


@query(
    "t2_two_phase_search",
    f"""WITH {SEARCH_SQL}, sheets AS (SELECT doc_id, regexp_matches(upper(source), 'SRC3|SRC7|SRC1') AS listed FROM documents),
    good AS (SELECT count(*) AS n FROM scored JOIN sheets USING (doc_id) WHERE listed AND score >= 100)
    SELECT doc_id, score, categories FROM scored JOIN sheets USING (doc_id), good WHERE listed OR n < 20""",
)
def t2(spark, folder):
    sheet = map_sheet(F.col("source"), fx.DOC_SHEETS)
    return search.two_phase_scores(fx.docs(spark, folder), TERMS, sheet, good=100, per_term=PER_TERM)
