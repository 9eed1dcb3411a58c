"""Centroid clustering by delta Lloyd.

Vectors lie in a table bucketed by a row key; each round's assignments (owner and squared distance) in a table bucketed
alike, so a round joins the two without a shuffle and writes only the small one. A round compares

* a vector whose owner's centroid stayed with the centroids that changed, against its stored distance;
* a vector whose owner's centroid changed with all centroids.

The first row of each Arrow batch carries the batch's signed transfers: for every cluster the sums and the count of
vectors that came, less those of vectors that left. They are added to the global sums, so no round sums up all members.
When no centroid changes, later rounds would change nothing and are left out. Whole numbers throughout, so results are
exact and the same in any order. Global sums and centroids are k rows; they are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, hadoop_path, partitions, table, written
from .vectors import matrix, whole_vectors

#: |component| below this: 64 squares of differences fit in a long.
LIMIT = 2**27
_SCHEMA = "row long, cluster int, distance long, moved array<struct<cluster:int,n:long,sums:array<long>>>"
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances. In doubles where every term is known to stay below 2**53."""
    if not len(x) or not len(centroids):
        return np.zeros((len(x), len(centroids)), np.int64)
    most = int(max(np.abs(x).max(), np.abs(centroids).max()))
    if 4 * most * most * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def nearest(x: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances. owner is -1 for a vector that has none yet; held: distances to the owners' centroids, unless those changed."""
    owner, held = owner.copy(), held.copy()
    fresh = (owner < 0) | changed[owner]
    if fresh.any():
        d = distances(x[fresh], centroids)
        owner[fresh] = d.argmin(1)  # the first of equals
        held[fresh] = d.min(1)
    stays, which = np.flatnonzero(~fresh), np.flatnonzero(changed)
    if len(stays) and len(which):
        d = distances(x[stays], centroids[which])
        at = d.argmin(1)
        best, new = d[np.arange(len(stays)), at], which[at]
        wins = (best < held[stays]) | ((best == held[stays]) & (new < owner[stays]))
        owner[stays[wins]], held[stays[wins]] = new[wins], best[wins]
    return owner, held


def _transfers(x: np.ndarray, was: np.ndarray, now: np.ndarray) -> list[dict]:
    """Signed sums and counts of the clusters that gained or lost a vector."""
    moved = was != now
    x, was, now = x[moved], was[moved], now[moved]
    out = []
    for c in np.unique(np.concatenate((was, now))):
        if c >= 0:
            sums = x[now == c].sum(0) - x[was == c].sum(0)
            out.append({"cluster": int(c), "n": int((now == c).sum() - (was == c).sum()), "sums": sums.tolist()})
    return out


def _assigned(shared, first: bool):
    def run(batches):
        centroids, changed = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), centroids.shape[1])
            was = np.full(len(x), -1, np.int64) if first else batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            held = np.zeros(len(x), np.int64) if first else batch.column("distance").to_numpy(zero_copy_only=False)
            now, held = nearest(x, centroids, changed, was, held)
            moved = [_transfers(x, was, now) or None, *[None] * (len(x) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(now, pa.int32()), pa.array(held, pa.int64()), pa.array(moved, _MOVED)], names=["row", "cluster", "distance", "moved"])

    return run


class Bucketed:
    """A table bucketed by `row` below the shared folder. Its name stands in the catalog until drop()."""

    def __init__(self, df: DataFrame, buckets: int, what: str):
        self.spark, self.name, self.path = df.sparkSession, f"almanack_{uuid.uuid4().hex}", fresh_path(df.sparkSession, what)
        df.write.bucketBy(buckets, "row").sortBy("row").option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        fs, p = hadoop_path(self.spark, self.path)
        fs.delete(p, True)


def delta_lloyd(vectors: Bucketed, start: list[list[int]], rounds: int, buckets: int) -> tuple[Bucketed, list[list[int]]]:
    """(assignments to the last centroids: row, cluster, distance; centroids). vectors: row, v. start: first centroids, one or more.

    Each of `rounds` assigns every vector to the nearest centroid (ties: the smaller number), then replaces each centroid
    that has vectors by floor(sum / count) of them. At the end vectors are assigned once more.
    """
    spark, width = vectors.spark, len(start[0])
    centroids, changed = [list(map(int, c)) for c in start], [True] * len(start)
    sums, counts = [[0] * width for _ in start], [0] * len(start)
    held: Bucketed | None = None
    for k in range(rounds + 1):
        shared = spark.sparkContext.broadcast((np.array(centroids, np.int64), np.array(changed)))
        rows = vectors.read().select("row", "v")
        if held:
            rows = rows.join(held.read().select("row", "cluster", "distance"), "row")
        nxt = Bucketed(rows.mapInArrow(_assigned(shared, held is None), _SCHEMA), buckets, "assigned")
        if held:
            held.drop()
        held = nxt
        shared.destroy()
        if k == rounds:
            break
        told = held.read().filter("moved is not null").select(F.inline("moved"))
        for r in told.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect():
            counts[r.cluster] += r.n
            sums[r.cluster] = [a + b for a, b in zip(sums[r.cluster], r.sums, strict=True)]
        new = [[s // n for s in t] if n else c for c, t, n in zip(centroids, sums, counts, strict=True)]
        changed = [a != b for a, b in zip(centroids, new, strict=True)]
        centroids = new
        if not any(changed):
            break
    return held, centroids


def first_by_hash(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose ids' SHA-256 of `seed:id` is least, in that order. Equal ids go by their components; null ids come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.select(key.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def clustered(embeddings: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row whose vector has `dims` finite components.

    Other rows are left out. Rows of one id are vectors of their own, null ids too; with fewer than k vectors there are as
    many centroids as vectors; an empty table gives no row. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    kept = whole_vectors(embeddings.select(F.col("vec_id"), F.col("embedding").alias("v")), scale, "v", LIMIT, dims)
    # the key is fixed once it is written; rows are dealt out by it as the buckets are
    buckets = partitions(spark)
    vectors = Bucketed(kept.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row"), buckets, "vectors")
    start = first_by_hash(vectors.read(), k, seed)
    if not start:
        out = vectors.read().select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return out.limit(0)
    held, centroids = delta_lloyd(vectors, start, rounds, buckets)
    own = held.read().groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # k rows at most
    by = {r.cluster: r.d for r in own}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    found = vectors.read().select("row", "vec_id").join(held.read().select("row", "cluster", "distance"), "row")
    out = written(found.select("vec_id", "cluster", "distance"), "clusters")
    held.drop()
    vectors.drop()
    inertia = [F.lit(by.get(c, 0)).cast("long") for c in range(len(centroids))]
    return out.select("vec_id", "cluster", "distance", pick(inertia).alias("cluster_inertia"), F.lit(sum(by.values())).cast("long").alias("inertia"), pick(digest).alias("centroid_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster after ten rounds from eight centroids."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64) -> str:
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, embedding AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, i, CAST(floor({scale} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dims + 1}) t(i))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM kept ORDER BY k LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT k, i, x AS c FROM first JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place FROM (SELECT r, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{n} USING (i) GROUP BY r, k)) WHERE place = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY k, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END AS c FROM c{n} LEFT JOIN m{n} USING (k, i))")
    named = f"names AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)"
    return f"WITH {', '.join(parts)}, {named} SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN names USING (k)"


OP12_SQL = _sql()
