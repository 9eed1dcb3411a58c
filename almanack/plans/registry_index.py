"""Queries on the persisted text index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources import adapters as D
from ..sources.store import fresh
from ..sources.text_index import TextIndex
from .registry import DOC, TERMS, query
from .registry_search import ENT, SINCE, UNTIL, entries

#: Columns of a document and what an occurrence in them counts.
WEIGHTS = {"title": 1.0, "body": 1.0, "tag": 0.5, "project": 0.5}


def weighted_sql(source: str, terms: list[str], weights: dict[str, float], kept: str = "TRUE") -> str:
    """CTEs up to bm(doc_id, n_terms, score): the full score of all rows of source, those that `kept` lets through."""
    words = ", ".join(rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+') AS w_{c}" for c in weights)
    tf = ", ".join(f"{' + '.join(f'{w}::DOUBLE * len(list_filter(w_{c}, lambda x: x = {t!r}))' for c, w in weights.items())} AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))" for i in range(len(terms)))
    return f"""w0 AS (SELECT *, {words} FROM {source}), w1 AS (SELECT *, {' + '.join(f'len(w_{c})' for c in weights)} AS dl, {tf} FROM w0), w2 AS (SELECT count(*) AS n, avg(dl) AS al, {df} FROM w1),
bm AS (SELECT doc_id, CAST({' + '.join(f'(f{i} > 0)::INT' for i in range(len(terms)))} AS BIGINT) AS n_terms, round({score}, 4) AS score FROM w1, w2 WHERE {' + '.join(f'f{i}' for i in range(len(terms)))} > 0 AND {kept})"""


def _built(spark, d, rows=None, **more) -> TextIndex:
    return TextIndex(spark, fresh(spark, "index")).build(D.document_entries(spark, d) if rows is None else rows, more.pop("columns", WEIGHTS), **{"width": 64} | more)


@query(f"WITH {weighted_sql(DOC, TERMS, WEIGHTS)} SELECT doc_id, score, CAST(greatest(0, least(100, floor(70 + 5 * score))) AS BIGINT) AS relevance, row_number() OVER (ORDER BY score DESC, doc_id) AS search_rank FROM bm ORDER BY search_rank LIMIT 100")
def s4_r2_o8_indexed_search(spark, d):
    """The hundred best documents from the index, columns weighted."""
    top = _built(spark, d).search(TERMS, 100)
    return S.ranked(top).select("doc_id", "score", S.relevance(F.col("score")).alias("relevance"), "search_rank")


_BOTH = ["apache", "version"]


@query(f"WITH {weighted_sql(DOC, _BOTH, WEIGHTS)}, n AS (SELECT count(*) FILTER (n_terms = 2) AS n FROM bm) SELECT bm.* FROM bm, n WHERE n_terms = 2 OR n < 3 ORDER BY score DESC, doc_id LIMIT 50")
def s4_u2_indexed_and_then_or(spark, d):
    return _built(spark, d).and_then_or(_BOTH, 50)


@query(f"WITH {weighted_sql(ENT, TERMS, {'title': 1.0, 'body': 1.0}, f'''date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' ''')} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 40")
def s4_indexed_search_of_dates(spark, d):
    """The best entries of a range of dates; statistics are those of all entries."""
    return _built(spark, d, entries(spark, d), columns={"title": 1.0, "body": 1.0}, day="date").search(TERMS, 40, SINCE, UNTIL)


@query(f"WITH {weighted_sql(f'(SELECT * FROM {DOC} WHERE coalesce(project, chr(0)) <> {chr(39)}src1{chr(39)})', TERMS, WEIGHTS)} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 100")
def s4_k3_search_after_updates(spark, d):
    """An index of the documents but the French ones, which come later; then those of one source go. As if made from the last state."""
    docs = D.document_entries(spark, d)
    index = _built(spark, d, docs.filter("coalesce(tag, '') <> 'fr'"))
    index.update(docs, docs.filter("tag = 'fr'").select("doc_id"))
    last = docs.filter("coalesce(project, chr(0)) <> 'src1'")
    index.update(last, docs.filter("project = 'src1'").select("doc_id"))
    index.compact()
    return index.search(TERMS, 100)


@query(f"WITH {weighted_sql(f'(SELECT doc_id, title, abstract, CASE WHEN tag = {chr(39)}de{chr(39)} THEN upper(body) || {chr(39)} apache{chr(39)} ELSE body END AS body, tag, project FROM {DOC} WHERE coalesce(project, chr(0)) <> {chr(39)}src2{chr(39)})', TERMS, {'title': 1.0, 'body': 1.0})} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 100")
def r25_search_behind_a_freshness_guard(spark, d):
    """The documents changed (German texts are longer, one source's are gone) after they were indexed, and nobody told the index."""
    docs = D.document_entries(spark, d)
    index = _built(spark, d, docs, columns={"title": 1.0, "body": 1.0})
    now = docs.filter("coalesce(project, chr(0)) <> 'src2'").withColumn("body", F.when(F.col("tag") == "de", F.concat(F.upper("body"), F.lit(" apache"))).otherwise(F.col("body")))
    return index.refreshed(now).search(TERMS, 100)
