"""Tables as entries and as an entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated entries; errors have no time of day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("doc_id"),
        F.to_date("ts").alias("date"),
        F.when(F.col("event_type") != "error", F.hour("ts") * 60 + F.minute("ts")).alias("time_minutes"),
        F.col("event_type").alias("topic"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("person"),
        "value", "props", "ts", "user_id",
    )


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries over several years, with person, place, topic and mood."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    c = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", F.col("n_name").alias("location"), "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("mood"), F.col("c_name").alias("person"), "location", F.col("c_mktsegment").alias("tag"), F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("person_id"))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.title(F.col("text")).alias("title"), T.abstract(F.col("text")).alias("abstract"), F.col("text").alias("body"), F.col("lang").alias("tag"), F.col("source").alias("project"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as a graph's nodes: id, type, name."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    parts = ((r, "region", "r_regionkey", "place", "r_name"), (n, "nation", "n_nationkey", "place", "n_name"), (s, "supplier", "s_suppkey", "actor", "s_name"))
    out = [t.select(F.concat(F.lit(f"{p}-"), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name")) for t, p, k, kind, name in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, relation, target."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    key = lambda p, c: F.concat(F.lit(f"{p}-"), F.col(c).cast("string"))
    return n.select(key("nation", "n_nationkey").alias("source"), F.lit("member_of").alias("relation"), key("region", "n_regionkey").alias("target")).unionByName(s.select(key("supplier", "s_suppkey").alias("source"), F.lit("lives_in").alias("relation"), key("nation", "s_nationkey").alias("target")))
