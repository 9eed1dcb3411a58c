"""Bucketed counts with three-valued predicates, bounds, denominators, facets and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def roles(entries: DataFrame, predicate: Column) -> DataFrame:
    """Adds role: matched, excluded, or unknown where the predicate is null."""
    return entries.withColumn("role", F.when(predicate, "matched").when(~predicate, "excluded").otherwise("unknown"))


def buckets(entries: DataFrame, predicate: Column, unit: str, date: str = "date") -> DataFrame:
    """bucket, n_matched, n_unknown, n_total, any_match; only buckets with an entry. Partial sums before the shuffle."""
    r = roles(entries, predicate).withColumn("bucket", T.bucket(F.col(date), unit))
    return r.groupBy("bucket").agg(F.count_if(F.col("role") == "matched").alias("n_matched"), F.count_if(F.col("role") == "unknown").alias("n_unknown"), F.count(F.lit(1)).alias("n_total")).withColumn("any_match", F.col("n_matched") > 0)


def summary(entries: DataFrame, predicate: Column, unit: str, date: str = "date") -> DataFrame:
    """One row: count, its bounds and the denominator. Unit entry counts entries, others buckets with a match."""
    if unit == "entry":
        r = roles(entries, predicate)
        hit, maybe, n = F.count_if(F.col("role") == "matched"), F.count_if(F.col("role") == "unknown"), F.count(F.lit(1))
        return r.agg(hit.alias("n"), hit.alias("n_min"), (hit + maybe).alias("n_max"), n.alias("denominator"))
    b = buckets(entries, predicate, unit, date)
    span = entries.agg(F.min(date).alias("a"), F.max(date).alias("z"), F.countDistinct(F.date_format(date, "yyyy-MM")).alias("months"))
    days = F.datediff("z", "a") + 1
    whole = {"day": days, "week": F.floor((days + 6) / 7), "month": F.col("months")}[unit]
    n = b.agg(F.count_if("any_match").alias("n"), F.count_if(~F.col("any_match") & (F.col("n_unknown") > 0)).alias("open"))
    return n.crossJoin(F.broadcast(span)).select("n", F.col("n").alias("n_min"), (F.col("n") + F.col("open")).alias("n_max"), F.coalesce(whole, F.lit(0)).cast("long").alias("denominator"))


def facet(entries: DataFrame, column: str, id_col: str = "doc_id", samples: int = 5) -> DataFrame:
    """value, n, samples (the least ids) and its place by (-n, value). The least ids are kept by a bounded aggregate, not a full list."""
    from pyspark.sql import Window

    v = entries.filter(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.col(id_col).alias("id")).distinct()
    w = Window.partitionBy("value").orderBy("id")
    top = v.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= samples).groupBy("value").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("samples"))
    n = v.groupBy("value").agg(F.count(F.lit(1)).alias("n")).join(top, "value")
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")).cast("long"))


def rollup(entries: DataFrame, date: str = "date") -> DataFrame:
    """Entries, first and last date by root, year and month."""
    e = entries.select(F.year(date).alias("year"), F.month(date).alias("month"), F.col(date).alias("d"), "location", "person")
    return e.rollup("year", "month").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.min("d").cast("string").alias("first_date"), F.max("d").cast("string").alias("last_date"), F.countDistinct("location").alias("n_locations"))


def coverage(entries: DataFrame, columns: list[str]) -> DataFrame:
    """signal, in_scope, present: one scan, one row per column."""
    one = entries.agg(F.count(F.lit(1)).alias("in_scope"), *(F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col("in_scope"), F.col(c).alias("present")) for c in columns))).alias("x")).select("x.*")
