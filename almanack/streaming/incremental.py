"""Incremental upkeep and detectors as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "doc_id", version: str = "version") -> None:
    """Bring a Parquet table of latest rows up to date with all files that came in since the last run, exactly once.

    Each batch writes a new generation below target; a batch that is replayed writes the same generation again.
    """
    incoming = spark.readStream.schema(schema).parquet(source)

    def apply(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(version)).alias("r")).select("r.*")
        if number:
            old = spark.read.schema(schema).parquet(f"{target}/gen={number - 1}")
            latest = latest.unionByName(old.join(latest, key, "left_anti"))
        latest.write.mode("overwrite").parquet(f"{target}/gen={number}")

    incoming.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling counts with a watermark; works on streams and tables."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(F.col(ts), size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", user: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Session windows per user."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(F.col(ts), gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def events_due(entries: DataFrame, who: str, audited: str, indexed: str, reviewed: list[str], version: int, versions: DataFrame, silence: int = 7, audit: int = 30) -> DataFrame:
    """event, key, days of what is due on the day of the newest entry: who was silent for `silence` days, an audit older than `audit` days, months
    without a review, an index older than the newest entry, rows of a newest schema version (version, rows: version).
    """
    now = entries.agg(F.max("date").alias("now"))
    row = lambda df, event, key, days: df.select(F.lit(event).alias("event"), key.cast("string").alias("key"), days.cast("long").alias("days"))
    gap = lambda day: F.datediff("now", F.lit(day).cast("date"))
    last = entries.groupBy(who).agg(F.max("date").alias("last")).crossJoin(F.broadcast(now)).withColumn("gap", F.datediff("now", "last")).filter(F.col("gap") >= silence)
    months = entries.select(F.date_format("date", "yyyy-MM").alias("m")).distinct().filter(~F.col("m").isin(reviewed) if reviewed else F.lit(True))
    out = row(last, "silence", F.col(who), F.col("gap")).unionByName(row(now.filter(gap(audited) >= audit), "audit_due", F.lit("all"), gap(audited))).unionByName(row(months, "monthly_review", F.col("m"), F.lit(0)))
    return out.unionByName(row(now.filter(gap(indexed) > 0), "stale_index", F.lit("all"), gap(indexed))).unionByName(row(versions.filter(F.col("version") == version).distinct(), "schema", F.col("version"), F.lit(0)))
