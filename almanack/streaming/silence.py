"""Silence of users, as a stream with a timer a user, and as a table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, last timestamp, due timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Silence(StatefulProcessor):
    """A user's stretches of events less than the gap apart, each as its first and last time, until the watermark is past its end.

    Events may come in any order within the watermark's delay: one that falls between two stretches joins them.
    """

    def __init__(self, gap: int):
        self.gap = gap  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long")

    def _stretches(self) -> list[tuple[int, int]]:
        return sorted((int(x[0]), int(x[1])) for x in self.open.get()) if self.open.exists() else []

    def _keep(self, stretches: list[tuple[int, int]]) -> None:
        if stretches:
            self.open.put(stretches)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        times = sorted(int(t) for frame in rows for t in frame["us"])
        before, merged = self._stretches(), []
        for first, last in sorted([*before, *((t, t) for t in times)]):
            if merged and first - merged[-1][1] < self.gap:
                merged[-1] = merged[-1][0], max(last, merged[-1][1])
            else:
                merged.append((first, last))
        if merged != before:
            self._keep(merged)
        # only timers of ends that changed: each is a message to the state store
        old, new = {last for _, last in before}, {last for _, last in merged}
        due = lambda ends: {(last + self.gap) // 1000 + 1 for last in ends}
        for t in due(old) - due(new):
            self.handle.deleteTimer(t)
        for t in due(new) - due(old):
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        stretches = self._stretches()
        over = [s for s in stretches if s[1] + self.gap <= now]
        self._keep([s for s in stretches if s[1] + self.gap > now])
        if over:
            at = lambda values: pd.to_datetime(pd.Series(values, dtype="int64"), unit="us")
            yield pd.DataFrame({"user_id": [key[0]] * len(over), "last": at([s[1] for s in over]), "due": at([s[1] + self.gap for s in over])})

    def close(self) -> None:
        pass


def silences(events: DataFrame, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """user_id, last, due of a stream of events (user_id, ts): told once the watermark is past due and nothing came in between.

    Rows later than `late` are left out by the watermark; rows without a user or time too. Needs the RocksDB state store (run() sets it).
    """
    own = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts")).filter("user_id is not null and ts is not null").withWatermark("ts", late)
    rows = own.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=_Silence(gap_seconds * 1_000_000), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def run(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, gap_seconds: int, late: str = "1 hour", files: int = 1) -> None:
    """Take in what came to the folder `source` since the last run, and add the silences that are certain to `target` (Parquet)."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        silences(stream, gap_seconds, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def batch_silences(events: DataFrame, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """The same of a table, as far as a watermark `late` behind its newest row would tell them."""
    own = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts")).filter("user_id is not null and ts is not null")
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    end = own.agg((F.max("ts") - F.expr(f"interval {late}")).alias("end"))
    gap = F.expr(f"interval {gap_seconds} seconds")
    rows = own.withColumn("following", following).filter(F.col("following").isNull() | (F.col("following") - F.col("ts") >= gap))
    return rows.select("user_id", F.col("ts").alias("last"), (F.col("ts") + gap).alias("due")).crossJoin(F.broadcast(end)).filter("due < end").drop("end")
