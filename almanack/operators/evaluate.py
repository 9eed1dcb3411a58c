"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """query_id, n_relevant, mrr, recall, precision, ndcg at k. run: query_id, doc_id, score; ties by doc_id. Queries of qrels without a run score 0."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = run.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    hits = top.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("hits"), F.sum(1 / F.log2(F.col("r") + 1)).alias("dcg"))
    rel = qrels.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_relevant"))
    size = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = rel.join(hits, "query_id", "left").join(size, "query_id", "left")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return j.select("query_id", "n_relevant", z(1 / F.col("first")).alias("mrr"), z(F.col("hits") / F.col("n_relevant")).alias("recall"), z(F.col("hits") / F.col("size")).alias("prec"), z(F.col("dcg") / ideal).alias("ndcg"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, status of two runs with columns query_id, passed."""
    j = a.select("query_id", F.col("passed").alias("pa")).join(b.select("query_id", F.col("passed").alias("pb")), "query_id", "full")
    return j.select("query_id", F.when(F.col("pa").isNull(), "new_in_candidate").when(F.col("pb").isNull(), "missing_from_candidate").when(F.col("pa") & F.col("pb"), "still_passing").when(~F.col("pa") & F.col("pb"), "fixed").when(F.col("pa"), "regressed").otherwise("still_failing").alias("status"))


def means(queries: DataFrame, run: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One row: n_queries (with a relevant document), n_skipped (without), mean MRR and recall at k; a query that the run lacks counts 0."""
    first = run.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("place") <= k)
    size = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    hits = first.join(relevant.distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("place").alias("f"))
    j = queries.join(size, "query_id", "left").join(hits, "query_id", "left")
    mean = lambda c: F.round(F.avg(F.when(F.col("size").isNotNull(), F.coalesce(c, F.lit(0.0)))), 4)
    return j.agg(F.count("size").alias("n_queries"), (F.count(F.lit(1)) - F.count("size")).alias("n_skipped"), mean(1 / F.col("f")).alias("mean_mrr"), mean(F.col("hits") / F.col("size")).alias("mean_recall"))
