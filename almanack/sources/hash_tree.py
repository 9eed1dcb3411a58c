"""Hash trees over ranges of keys: two versions of a table are compared by descending only where hashes differ.

Level 0 has a node for each page of `fanout` keys (page = key // fanout): the hash of its rows' hashes in order of key. A
node of a higher level is the hash of up to `fanout` nodes below it, with their numbers. No list is longer than that, if
keys are unique (rows of one key add to its page). Levels are Parquet folders, sorted by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh


def _joined(number: str, value: str):
    """SHA-256 over (number, value) pairs in their order."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), F.col(value).alias("v")))), lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["v"])), ","), 256)


class HashTree:
    """A tree below a path: level=0, level=1, ... up to the level that has one node. Keys are whole numbers; rows without one are left out."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 64):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    def _level(self, k: int) -> DataFrame:
        return self.spark.read.schema("node long, hash string").parquet(f"{self.path}/level={k}")

    def height(self) -> int:
        """The level of the root."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return max(int(s.getPath().getName()[6:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("level="))

    def _leaves(self, rows: DataFrame, key: str) -> DataFrame:
        names = [c for c in sorted(rows.columns) if c != key]
        # nulls differ from empty texts
        row = F.sha2(F.concat_ws("\0", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in names)), 256)
        own = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), row.alias("hash"))
        return own.groupBy(F.floor(F.col("key") / self.fanout).cast("long").alias("node")).agg(_joined("key", "hash").alias("hash"))

    def _above(self, nodes: DataFrame) -> DataFrame:
        return nodes.groupBy(F.floor(F.col("node") / self.fanout).cast("long").alias("up")).agg(_joined("node", "hash").alias("hash")).select(F.col("up").alias("node"), "hash")

    def _save(self, nodes: DataFrame, k: int) -> DataFrame:
        nodes.sortWithinPartitions("node").write.mode("overwrite").parquet(f"{self.path}/level={k}")
        return self._level(k)

    def build(self, rows: DataFrame, key: str) -> HashTree:
        nodes, k = self._save(self._leaves(rows, key), 0), 0
        while k == 0 or nodes.limit(2).count() > 1:
            nodes, k = self._save(self._above(nodes), k + 1), k + 1
        return self

    def updated(self, path: str, rows: DataFrame, key: str, changed: DataFrame) -> HashTree:
        """The tree of rows as they are now, at another path; changed: keys (column `key`) that came, changed or went.

        Only pages with such keys, and the nodes above them, are worked out again; other nodes are taken over.
        """
        new = HashTree(self.spark, path, self.fanout)
        touched = changed.select(F.floor(F.col("key") / self.fanout).cast("long").alias("node")).filter("node is not null").distinct()
        page = F.floor(F.col(key) / self.fanout).cast("long")
        fresh_nodes = new._leaves(rows.join(touched, page == F.col("node"), "left_semi"), key)
        nodes = new._save(self._level(0).join(touched, "node", "left_anti").unionByName(fresh_nodes), 0)
        k, top = 0, self.height()
        while k == 0 or nodes.limit(2).count() > 1:
            touched = touched.select(F.floor(F.col("node") / self.fanout).cast("long").alias("node")).distinct()
            own = nodes.join(touched, F.floor(nodes["node"] / self.fanout).cast("long") == touched["node"], "left_semi")
            k += 1
            old = self._level(k).join(touched, "node", "left_anti") if k <= top else None
            nodes = new._save(new._above(own) if old is None else old.unionByName(new._above(own)), k)
        return new

    def differing(self, other: HashTree) -> tuple[DataFrame, list[int]]:
        """(page: pages whose hashes differ or that one tree lacks; how many nodes of each level were compared, from the top).

        A level's nodes are read only below nodes that differ. Trees of different heights are compared from the lower one's root level.
        """
        pages, read = None, []
        for k in range(min(self.height(), other.height()), -1, -1):
            a, b = self._level(k), other._level(k).withColumnRenamed("hash", "theirs")
            if pages is not None:
                up = lambda df: df.join(pages, F.floor(df["node"] / self.fanout).cast("long") == pages["up"], "left_semi")  # noqa: E731, B023
                a, b = up(a), up(b)
            both = a.join(b, "node", "full")
            path = fresh(self.spark, "differing")
            both.withColumn("differs", ~F.col("hash").eqNullSafe(F.col("theirs"))).select("node", "differs").write.parquet(path)
            held = self.spark.read.schema("node long, differs boolean").parquet(path)
            read.append(held.count())
            pages = held.filter("differs").select(F.col("node").alias("up"))
        return pages.select(F.col("up").alias("page")), read


def changes(before: DataFrame, after: DataFrame, key: str, old: HashTree, new: HashTree) -> DataFrame:
    """key, change (added, removed, changed) of rows that differ, read from differing pages only."""
    pages, _ = old.differing(new)
    page = lambda df: df.join(pages, F.floor(df[key] / old.fanout).cast("long") == pages["page"], "left_semi")
    columns = [c for c in sorted(before.columns) if c != key]
    a, b = page(before).select(F.col(key).alias("key"), F.struct(*columns).alias("was")), page(after).select(F.col(key).alias("key"), F.struct(*columns).alias("now"))
    both = a.join(b, "key", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select("key", change.alias("change")).filter("change is not null")
