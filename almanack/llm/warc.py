"""WARC archives of captures, and their merged capture index.

Writing: payload digests are taken where the rows are read; of equal payloads the capture with the least id is the
response, all others revisit it. Records are made of column expressions and written by Spark's text writer with the
record end as separator and gzip compression, so archives go to any store that Spark writes, and a lost task is redone.

The payloads are read twice: for their digests, which name the revisits, and to be written. Archives are cut by bytes:
captures go to files by size class, each with as many records as fit in `file_bytes`.

Reading: each archive is read and parsed by one task, which checks every digest, and yields the file's captures as a
sorted run. Spark deals the runs out by ranges of (URL key, timestamp, id, file, number), null ids first, and hands each
range's parts over run by run, each in its own order; they are merged k ways by a loser tree, which takes keys from the
runs as it goes and sorts nothing. The ranges in their order are the globally ordered capture history. Bounds are whole
keys, so one URL, or one key, time and id, with a third of all captures is cut as well. An index row has the record's
number and its offset in the archive's uncompressed bytes (Spark's writer makes one gzip member of a file, so there are no
offsets of members).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, partitions, table, written

END = "\r\n\r\n"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "urlkey string, ts string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, number long, offset long, place long"


def base32_of_hex(column: str) -> str:
    """SQL: upper-case base32 of a 40-digit hex string (five hex digits make four letters)."""
    letter = lambda shift: f"substring('{_B32}', cast(shiftright(v, {shift}) & 31 as int) + 1, 1)"
    return f"array_join(transform(sequence(0, 7), i -> element_at(transform(array(cast(conv(substring({column}, 5 * i + 1, 5), 16, 10) as long)), v -> concat({letter(15)}, {letter(10)}, {letter(5)}, {letter(0)})), 1)), '')"


def captures(pages: DataFrame, id_col: str, url_col: str, html_col: str, when=None) -> DataFrame:
    """page_id, url, at, ts, payload, n and digest of every row."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"), (when if when is not None else F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))).alias("at"))
    p = p.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.expr(base32_of_hex("sha1(encode(payload, 'UTF-8'))")), "ts": F.date_format("at", "yyyyMMddHHmmss")})
    return p


def revisits(p: DataFrame, min_bytes: int) -> DataFrame:
    """digest, n, first: of payloads that several captures hold, the least id. Summed in parts before the shuffle."""
    return p.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest", "n", "first")


def _record_id(col):
    """A URN with the 64-bit id inside."""
    h = F.lpad(F.hex(col), 16, "0")
    return F.concat(F.lit("<urn:uuid:"), F.lower(F.substring(h, 1, 8)), F.lit("-"), F.lower(F.substring(h, 9, 4)), F.lit("-8000-8000-00000000"), F.lower(F.substring(h, 13, 4)), F.lit(">"))


def record_text(p: DataFrame):
    """The record of a row (without its end): headers, HTTP headers and, for responses, the payload."""
    response = F.col("first").isNull() | (F.col("first") == F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    body = F.concat(http, F.when(response, F.col("payload")).otherwise(""))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"), F.lit("\r\n"),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", uri),
        line("WARC-Date", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, "").otherwise(F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", _record_id(F.col("first"))))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


#: Greatest payloads of the size classes; each gets files of its own.
CLASSES = (32 << 10, 1 << 20, 32 << 20)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, when=None, file_bytes: int = 256 << 20, most_broadcast: int = 300_000) -> None:
    """Write the captures' archives below path (gzip). when: a timestamp column; else seconds after 2024 by id.

    Every row becomes a record. A null payload is an empty one; a null id makes a record without id, always a response; a null
    URL one without target. Rows with one id and one payload are all responses. Revisits are marked by broadcast while
    there are at most most_broadcast of them, else by a join.
    """
    p = captures(pages, id_col, url_col, html_col, when)
    named = written(p.select("page_id", "url", "digest", "n"), "digests")
    dup = revisits(named, min_bytes)
    # equal payloads may be a third of all: the small side is copied to salts, the rows are dealt over them
    salts = 16
    rows = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    heads = dup.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    marks = rows.filter(F.col("n") >= min_bytes).select("page_id", "digest", "n", "salt").join(heads, ["digest", "n", "salt"]).select("page_id", "digest", "n", "first").filter("first != page_id").distinct()
    marks = written(marks, "revisits")
    marks = F.broadcast(marks) if marks.count() <= most_broadcast else marks
    own = p.join(marks, ["page_id", "digest", "n"], "left")
    # a task's rows are numbered as they come; so many of a class in a row share a folder, and so a file
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    share = [max(1, file_bytes // (top + 1024)) for top in (*CLASSES, file_bytes)]
    part = F.coalesce(*(F.when(F.col("n") <= top, F.concat(F.lit(f"{k}-"), F.floor(number / share[k]))) for k, top in enumerate(CLASSES)), F.concat(F.lit(f"{len(CLASSES)}-"), F.floor(number / share[-1])))
    own.select(record_text(p).alias("value"), part.alias("part")).write.partitionBy("part").option("lineSep", END).option("compression", "gzip").text(path)


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: reversed host, then the rest in lower case."""
    rest = (url or "").partition("://")[2] or (url or "")
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().partition("@")[2].split(".") if "@" in rest[:cut] else rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0].lower()


class Broken(ValueError):
    """An archive that isn't as its headers say."""


def _id(urn: str | None) -> int | None:
    if not urn:
        return None
    h = urn.removeprefix("<urn:uuid:").rstrip(">").split("-")
    n = int(h[0] + h[1] + h[4][-4:], 16)
    return n - (1 << 64) if n >> 63 else n


def records(stream) -> object:
    """(offset, headers, block) of each record of an open archive."""
    while True:
        offset = stream.tell()
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            offset = stream.tell()
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise Broken(line[:40])
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        n = int(head["Content-Length"])
        block = stream.read(n)
        if len(block) != n:
            raise Broken("short record")
        yield offset, head, block


def capture_of(head: dict, block: bytes) -> dict:
    """Index row of a record; the digest of a response's payload is checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise Broken(f"payload of {head.get('WARC-Record-ID')}")
    url = head.get("WARC-Target-URI")
    ts = "".join(c for c in head["WARC-Date"] if c.isdigit())
    return {"urlkey": surt(url), "ts": ts, "page_id": _id(head.get("WARC-Record-ID")), "url": url, "record_type": head["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": _id(head.get("WARC-Refers-To"))}


def _order(row: dict) -> tuple:
    """Null ids come first."""
    return row["urlkey"], row["ts"], row["page_id"] is not None, row["page_id"] or 0, row["file"], row["number"]


def _parse(batches):
    """Each archive's captures, as one sorted run."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = []
            stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
            for number, (offset, head, block) in enumerate(records(stream)):
                rows.append(capture_of(head, block) | {"file": "/".join(path.split("/")[-2:]), "number": number, "offset": offset})
            rows.sort(key=_order)
            for place, row in enumerate(rows):
                row["place"] = place
            yield pa.RecordBatch.from_pylist(rows, schema)


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, so the next winner takes one path to the root."""

    def __init__(self, runs: list, key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.head = [self._next(i) for i in range(len(runs))] or [None]
        self.tree = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._wins(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _wins(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a][0], a) < (self.head[b][0], b)

    def __iter__(self):
        while self.head[self.winner] is not None:
            w = self.winner
            yield self.head[w][1]
            self.head[w] = self._next(w)
            node = (w + self.k) // 2
            while node:
                if self._wins(self.tree[node], w):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.winner = w


def _order_at(run: pa.Table, offset: int):
    """(key, row number) of a run's rows in their order, taken from the columns a thousand at a time."""
    for at in range(0, run.num_rows, 1000):
        keys, times, ids, files, numbers = (run.column(c).slice(at, 1000).to_pylist() for c in ("urlkey", "ts", "page_id", "file", "number"))
        for k, i in enumerate(ids):
            yield (keys[k], times[k], i is not None, i or 0, files[k], numbers[k]), offset + at + k


def merged(part: pa.Table) -> np.ndarray:
    """The order of a range's rows, which come run by run, each run in its own order."""
    files = part.column("file").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
    runs = [_order_at(part.slice(a, b - a), a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.fromiter((row for _, row in LoserTree(runs, lambda r: r[0])), np.int64, len(files))


def _merge(batches):
    """One range a task: its runs' parts merged."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    part = pa.Table.from_batches(held)
    order, number = merged(part), TaskContext.get().partitionId()
    for at in range(0, len(order), 10_000):
        own = part.take(pa.array(order[at : at + 10_000])).drop_columns(["place"])
        own = own.append_column("range_no", pa.array([number] * own.num_rows, pa.int64())).append_column("position", pa.array(range(at, at + own.num_rows), pa.int64()))
        yield from own.combine_chunks().to_batches()


def read(spark, path: str, rows_per_range: int = 50_000) -> DataFrame:
    """The captures of the archives below path as one history: the columns of INDEX but place, range_no and position.

    Ordered by (range_no, position), captures are in order of URL key, timestamp and id. An archive without a record, and a
    folder without an archive, have no capture.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("path", "content")
    index = written(files.mapInArrow(_parse, INDEX), "index")
    n = max(partitions(spark), -(-index.count() // rows_per_range))
    dealt = index.repartitionByRange(n, "urlkey", "ts", F.asc_nulls_first("page_id"), "file", "number").sortWithinPartitions("file", "place")
    return dealt.mapInArrow(_merge, INDEX.removesuffix(", place long") + ", range_no long, position long")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by the merged index."""
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX5 = "list_transform(range(0, 8), lambda i: CAST(('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5)) AS BIGINT))"
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS n, array_to_string(list_transform({_HEX5}, lambda v:
        substr('{_B32}', CAST(v // 32768 + 1 AS INTEGER), 1) || substr('{_B32}', CAST(v // 1024 % 32 + 1 AS INTEGER), 1) ||
        substr('{_B32}', CAST(v // 32 % 32 + 1 AS INTEGER), 1) || substr('{_B32}', CAST(v % 32 + 1 AS INTEGER), 1)), '') AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
