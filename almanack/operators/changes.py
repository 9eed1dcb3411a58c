"""Change sets, fusion, merges and checks between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_set(old: DataFrame, new: DataFrame, key: str = "doc_id", digest: str = "hash") -> DataFrame:
    """key, change: added, updated, removed or same; one full join on the key."""
    j = old.select(key, F.col(digest).alias("o")).join(new.select(key, F.col(digest).alias("n")), key, "full")
    return j.select(key, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "updated").otherwise("same").alias("change"))


def freshness(source: DataFrame, derived: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, reason: the first that fails of scope_missing, removed_scope, source_hash_mismatch; else fresh."""
    j = source.select(key, F.col("hash").alias("s")).join(derived.select(key, F.col("hash").alias("d")), key, "full")
    return j.select(key, F.when(F.col("d").isNull(), "scope_missing").when(F.col("s").isNull(), "removed_scope").when(F.col("s") != F.col("d"), "source_hash_mismatch").otherwise("fresh").alias("reason"))


def fuse(results: dict[str, DataFrame], most: int = 15) -> DataFrame:
    """doc_id, source_queries, score, place: the union of several results (doc_id, score), the best score of each, the first `most`."""
    rows = reduce(DataFrame.unionByName, (r.select("doc_id", "score", F.lit(q).alias("q")) for q, r in results.items()))
    g = rows.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("q")), ",").alias("source_queries"), F.max("score").alias("score"))
    return g.orderBy(F.desc("score"), "doc_id").limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


def merge_tiers(l3: DataFrame, l2: DataFrame, l1: DataFrame) -> DataFrame:
    """doc_id, tier, score: rows of three tiers by doc_id; tier 3 wins and gets tier 2's bonus, tier 1 alone scores 10."""
    j = l3.select("doc_id", F.col("score").alias("s3")).join(l2.select("doc_id", F.col("bonus").alias("s2")), "doc_id", "full").join(l1.select("doc_id", F.lit(10.0).alias("s1")), "doc_id", "full")
    bonus = F.greatest(F.coalesce(F.col("s2") - 30, F.lit(0.0)), F.lit(0.0))
    return j.select("doc_id", F.when(F.col("s3").isNotNull(), 3).when(F.col("s2").isNotNull(), 2).otherwise(1).cast("long").alias("tier"), F.round(F.when(F.col("s3").isNotNull(), F.col("s3") + bonus).otherwise(F.coalesce("s2", "s1")), 4).alias("score"))
