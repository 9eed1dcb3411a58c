"""Vector code compression: product codes, entries found by annular norm pruning.

A vector's equal consecutive parts each get the number of the nearest entry in that position's codebook. Codebooks are
refined by rounds of assignment and averaging. Finding an entry: those of a position are sorted by norm; the one of
nearest norm gives a first distance d; by the triangle inequality only entries whose norm lies within d of the part's own
can be nearer or as near, an interval found by binary search. The annulus is walked from the inside out, both ends included, and
is drawn closer as d falls; distances are exact, in whole numbers, so pruning changes the work and not the result.

Codebooks (parts x entries x width numbers) are all that goes to the driver or to every task; sums are added up in the
tasks and once more by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written
from .vectors import matrix, whole_vectors

#: |component| below this: squared distances of some thousand components fit in a long.
LIMIT = 2**24
SALTS = 16


class Annuli:
    """Entries of one position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.order], norms[self.order]
        self.evaluated = 0  # distances worked out, of rows * entries

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest entries (of equals the lower) and the squared distances."""
        own, last = np.sqrt((x * x).sum(1).astype(np.float64)), len(self.norms) - 1
        right = np.clip(np.searchsorted(self.norms, own), 0, last)
        left = np.maximum(right - 1, 0)
        at = np.where(np.abs(self.norms[left] - own) <= np.abs(self.norms[right] - own), left, right)
        best = ((x - self.entries[at]) ** 2).sum(1)
        code = self.order[at]
        self.evaluated += len(x)
        slack = 1e-9 * (own + self.norms[last]) + 1e-6  # roots are rounded; a wider interval loses nothing
        reach = np.sqrt(best.astype(np.float64)) + slack
        low, high = np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")
        for step in range(1, last + 1):
            more = False
            for j in (at - step, at + step):
                rows = np.flatnonzero((j >= low) & (j < high))
                if not len(rows):
                    continue
                rows = rows[np.abs(self.norms[j[rows]] - own[rows]) <= reach[rows]]
                more = True
                d = ((x[rows] - self.entries[j[rows]]) ** 2).sum(1)
                self.evaluated += len(rows)
                number = self.order[j[rows]]
                wins = (d < best[rows]) | ((d == best[rows]) & (number < code[rows]))
                won = rows[wins]
                best[won], code[won] = d[wins], number[wins]
                reach[won] = np.sqrt(best[won].astype(np.float64)) + slack[won]
            if not more:
                break
        return code, best


def encode(x: np.ndarray, annuli: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances by row and part. x: rows x dimensions."""
    width = x.shape[1] // len(annuli)
    found = [a.nearest(x[:, p * width : (p + 1) * width]) for p, a in enumerate(annuli)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(shared):
    """For each entry in use, the sums and the number of its parts in this task."""

    def run(batches):
        books = shared.value
        parts, entries, width = books.shape
        annuli = [Annuli(b) for b in books]
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), parts * width)
                codes, _ = encode(x, annuli)
                for p in range(parts):
                    at = codes[:, p] + p * entries
                    np.add.at(sums, at, x[:, p * width : (p + 1) * width])
                    counts += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    return run


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """Codebooks (parts x entries x width), or None where there is no vector. vectors: vec_id, v (whole numbers, of one length).

    Each position starts as that part of the vectors with the `entries` least ids (equal ids by their components, null
    ids last; fewer vectors: fewer entries). A round replaces each used entry by floor(sum / count) of its parts.
    """
    start = [r.v for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    if not start:
        return None
    first = np.array(start, np.int64)
    if first.shape[1] % parts or not first.shape[1]:
        raise ValueError(f"vectors of {first.shape[1]} components can't be cut into {parts} equal parts")
    width = first.shape[1] // parts
    books = np.stack([first[:, p * width : (p + 1) * width] for p in range(parts)])
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)
        told = vectors.select("v").mapInArrow(_sums(shared), "entry int, n long, sums array<long>")
        rows = told.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()  # parts * entries rows
        shared.destroy()
        new = books.copy()
        for r in rows:
            new[r.entry // len(start), r.entry % len(start)] = [s // r.n for s in r.sums]
        if (new == books).all():
            break  # later rounds would change nothing
        books = new
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vectors with code (two hex digits a part) and error (squared distance) in place of v."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    others = [c for c in vectors.columns if c != "v"]
    digits = [f"{k:02x}" for k in range(books.shape[1])]

    def run(batches):
        annuli = [Annuli(b) for b in shared.value]
        for batch in batches:
            codes, errors = encode(matrix(batch.column("v"), shared.value.shape[0] * shared.value.shape[2]), annuli)
            text = ["".join(digits[c] for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(text, pa.string()), pa.array(errors.sum(1), pa.int64())], names=[*others, "code", "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "v")
    return vectors.mapInArrow(run, f"{kept}, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """codes with the vectors that the codes stand for as `approximation`: each part's entry, over `scale`."""
    entry = F.array(*(F.array(*(F.array(*(F.lit(float(x) / scale) for x in e)) for e in b)) for b in books))
    number = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximation", F.concat(*(F.element_at(F.element_at(entry, p + 1), number(p) + 1) for p in range(len(books)))))


def compressed(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a vector of finite components.

    Vectors of another length than that of the least id go (there is no distance between them). Rows of one id are rows
    of their own; null ids are kept. label_error sums over rows of one label, nulls together; without a column `label`
    all labels are null. An empty table gives no row; other columns are ignored.
    """
    label = F.col("label").cast("long") if "label" in embeddings.columns else F.lit(None).cast("long")
    kept = whole_vectors(embeddings.select("vec_id", label.alias("label"), F.col("embedding").alias("v")), scale, "v", LIMIT)
    vectors = written(kept, "vectors")
    least = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select(F.size("v").alias("n")).collect()
    if not least:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    vectors = vectors.filter(F.size("v") == least[0].n)
    books = fit(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    out = written(coded(vectors, books), "codes")
    # a label may hold a third of all rows: its sum is copied once a salt, so its rows are joined by several tasks
    salts = max(SALTS, partitions(out.sparkSession) // 8)
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = out.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    same = salted["label"].eqNullSafe(sums["label"]) & (salted["salt"] == sums["salt"])
    return salted.join(sums, same).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its code of eight parts after six rounds from sixteen entries a part."""
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS r, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (i - 1) // (len(e) // {parts}) AS p, (i - 1) % (len(e) // {parts}) AS j, CAST(floor({scale} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS i FROM kept))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries})",
        "c0 AS MATERIALIZED (SELECT p, k, j, x AS c FROM first JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p, k, d FROM (SELECT r, p, k, d, row_number() OVER (PARTITION BY r, p ORDER BY d, k) AS place FROM (SELECT r, p, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{n} USING (p, j) GROUP BY r, p, k)) WHERE place = 1)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT p, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (r, p) GROUP BY p, k, j)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT p, k, j, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END AS c FROM c{n} LEFT JOIN m{n} USING (p, k, j))")
    steps.append(f"books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"codes AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (r), books"


OP13_SQL = _sql()
