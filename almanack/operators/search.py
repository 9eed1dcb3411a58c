"""Ranked text search: BM25, bonuses, thresholds and labels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Usual BM25 parameters; the share of the score scale.
K1, B = 1.2, 0.75


def bm25(entries: DataFrame, terms: list[str], column: str = "body", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_terms (distinct query terms), score. One scan: each text counts the query's terms and its own length.

    Nothing is cut into words: lengths and terms are counted in place, terms only where the text holds them. No posting of
    a term outside the query is made or shuffled; the corpus statistics are one row.
    """
    low = F.lower(column)
    count = lambda q: F.when(low.contains(q), F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(q)}(?![\p{{L}}\p{{N}}])"))).otherwise(0)
    t = entries.select(F.col(id_col).alias("doc_id"), F.regexp_count(column, F.lit(r"[\p{L}\p{N}]+")).alias("dl"), *(count(q).alias(f"tf{i}") for i, q in enumerate(terms)))
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    one = F.broadcast(stats)
    rows = t.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(one)
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    n_terms = sum((F.when(F.col(f"tf{i}") > 0, 1).otherwise(0) for i in range(len(terms))), F.lit(0))
    return rows.select("doc_id", n_terms.cast("long").alias("n_terms"), F.round(score, 4).alias("score"))


def relevance(score):
    """0 to 100 from a positive BM25 score."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(70 + 5 * score))).cast("long")


def and_then_or(scored: DataFrame, n_query: int, least: int = 3) -> DataFrame:
    """Rows with all terms if there are at least `least`, else rows with any: both counts come from one pass."""
    n_all = scored.agg(F.count_if(F.col("n_terms") == n_query).alias("n_all"))
    return scored.crossJoin(F.broadcast(n_all)).filter((F.col("n_all") < least) | (F.col("n_terms") == n_query)).drop("n_all")


def metadata_bonus(entries: DataFrame, terms: list[str], base: float = 30.0, title: float = 8.0, abstract: float = 4.0, tag: float = 3.0) -> DataFrame:
    """doc_id, bonus: per term once for title, abstract and tag."""
    total = F.lit(base)
    for q in terms:
        for c, v in (("title", title), ("abstract", abstract), ("tag", tag)):
            total = total + F.when(F.lower(c).contains(q), v).otherwise(0.0)
    return entries.select("doc_id", total.alias("bonus")).filter(F.col("bonus") > base)


def ranked(scored: DataFrame, score: str = "score") -> DataFrame:
    """Adds search_rank by (-score, doc_id)."""
    return scored.withColumn("search_rank", F.row_number().over(Window.orderBy(F.desc(score), "doc_id")).cast("long"))


def tukey(scored: DataFrame, score: str = "score", base: float = 25.0, least: int = 8) -> DataFrame:
    """One row: n, q1, q3, fence (q1 - 1.5 IQR, base at least; base for fewer than `least` rows). Quartiles are values by rank, read off the
    counts of different scores, so that no task sorts all rows.
    """
    c = scored.filter(F.col(score) > 0).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumns({"upto": F.sum("c").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy())})
    q = c.groupBy("n").agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 4), F.col("s"))).alias("q1"), F.min(F.when(F.col("upto") > F.floor(3 * F.col("n") / 4), F.col("s"))).alias("q3"))
    fence = F.when(F.col("n") >= least, F.greatest(F.lit(base), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))).otherwise(F.lit(base))
    return q.select("n", "q1", "q3", F.round(fence, 4).alias("fence"))


def confidence(score):
    return F.when(score >= 50, "medium").otherwise("low")
