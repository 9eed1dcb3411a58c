"""Keyed rows kept as sorted runs by level: upserts and deletes come in batches, and no batch rewrites the table.

A batch becomes one run of level 0: the latest row of each of its keys, sorted by key, deletions as tombstones. Where a
level has `fanout` runs, they are merged into one run of the next level; so each row is read and written once a level, and
there are fewer than fanout runs a level, of levels as many as the logarithm of the number of batches. Tombstones go when
no older run is left below them.

Layout below a path: run=<name> (Parquet) and live/batch=<n>: the runs that count after batch n. live is written last, so a
batch that is replayed starts from the same runs, writes the same names again and ends in the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Runs:
    """The table below a path. schema: DDL of the rows; key, version and a boolean `deleted` are among its columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str = "version", fanout: int = 4):
        self.spark, self.path, self.key, self.version, self.fanout = spark, path.rstrip("/"), key, version, fanout
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = spark.createDataFrame([], schema + ", _batch long").schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # which runs count -------------------------------------------------------------------------------------------------
    def _batches(self) -> list[int]:
        p = self._path(f"{self.path}/live")
        told = [s.getPath() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(x.getName()[6:]) for x in told if x.getName().startswith("batch=") and self._fs.exists(self._path(x, "_SUCCESS")))

    def live(self, batch: int | None = None) -> list[tuple[int, str]]:
        """(level, name) of the runs that count after the last batch, or after `batch`, newest first."""
        known = [b for b in self._batches() if batch is None or b <= batch]
        if not known:
            return []
        rows = self.spark.read.schema("place int, level int, name string").json(f"{self.path}/live/batch={known[-1]}").collect()  # a few a level
        return [(r.level, r.name) for r in sorted(rows, key=lambda r: r.place)]

    def _tell(self, batch: int, runs: list[tuple[int, str]]) -> None:
        rows = self.spark.createDataFrame([(k, level, name) for k, (level, name) in enumerate(runs)], "place int, level int, name string")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/live/batch={batch}")

    # rows -------------------------------------------------------------------------------------------------------------
    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*(f"{self.path}/run={n}" for n in names)) if names else self.spark.createDataFrame([], self.stored)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The row of the greatest version of each key, of equal versions that of the later batch.

        Rows are dealt out by key before they are grouped: they are sorted for it, and a part of a file may be more than a task can sort.
        """
        kept = F.max_by(F.struct(*self.stored.names), F.struct(self.version, "_batch"))
        return rows.repartition(self.key).groupBy(F.col(self.key).alias("_k")).agg(kept.alias("_r")).select("_r.*")

    def _save(self, rows: DataFrame, name: str) -> None:
        """Rows of _latest(), so dealt out by key."""
        rows.sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/run={name}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in one batch. Rows without a key are left out; a null `deleted` is false."""
        before = self.live(number - 1)
        rows = batch.filter(F.col(self.key).isNotNull()).select(*self.schema.names).withColumns({"deleted": F.coalesce("deleted", F.lit(False)), "_batch": F.lit(number).cast("long")})
        self._save(self._latest(rows), f"{number}-0")
        runs = [(0, f"{number}-0"), *before]
        level = 0
        while len(own := [n for at, n in runs if at == level]) >= self.fanout:
            below = [r for r in runs if r[0] > level]
            merged = self._latest(self._read(own))
            merged = merged if below else merged.filter(~F.col("deleted"))
            level += 1
            self._save(merged, f"{number}-{level}")
            runs = [(level, f"{number}-{level}"), *below]
        self._tell(number, runs)
        # what neither this state nor the one before it needs can go: a replay of this batch starts from the latter
        held = {n for _, n in [*runs, *before]}
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("run=") and name[4:] not in held and int(name[4:].split("-")[0]) <= number:
                self._fs.delete(s.getPath(), True)

    def read(self) -> DataFrame:
        """The latest rows, without those that are deleted."""
        return self._latest(self._read([n for _, n in self.live()])).filter(~F.col("deleted")).select(*self.schema.names).drop("deleted")

    def consume(self, queue: str, checkpoint: str, files: int | None = None) -> None:
        """Take in all files of a folder that came since the last call, as a stream; files: how many make a batch at most."""
        incoming = self.spark.readStream.schema(self.schema)
        incoming = incoming.option("maxFilesPerTrigger", files) if files else incoming
        incoming.parquet(queue).writeStream.foreachBatch(lambda batch, n: self.apply(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
