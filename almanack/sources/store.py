"""Stores of derived data: shared folders, logs, review tables, entries with revisions, backups, import sources, pending writes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master, as in tests, may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/almanack-store"
    return found.rstrip("/")


_owned: set[str] = set()


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in a folder of this application's own, which goes when the driver ends."""
    own = f"{shared_dir(spark)}/almanack-store-{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_remove, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def _remove(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may have ended before
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once: written to the shared folder and read again."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt out by hash to twice as many partitions as a shuffle has. They stay apart: what is made of them takes more memory than
    their size tells. With as many, Spark would leave this out where rows lie so already, and put partitions together."""
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, since: str, until: str, ts: str = "ts") -> DataFrame:
    """Log rows of a time range; lines that are no JSON object of the schema are skipped."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("_bad").isNull() & F.col(ts).between(since, until)).drop("_bad")


def export_review(rows: DataFrame, path: str) -> None:
    """A table for review in a spreadsheet: CSV with a header, all values quoted, nulls told from empty texts."""
    rows.write.option("header", True).option("quoteAll", True).option("nullValue", "\\N").option("escape", '"').csv(path)


def import_review(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "\\N").option("escape", '"').option("multiLine", True).csv(path)


def edited(entries: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries after the edits, revisions: the rows as they were).

    edits: doc_id, field_topic (null: as it was), body, mode (append or replace; null: body as it was). One join, small side first.
    """
    j = entries.join(edits.select("doc_id", "field_topic", F.col("body").alias("new_body"), "mode", F.lit(True).alias("hit")), "doc_id", "left")
    body = F.when(F.col("mode") == "replace", F.col("new_body")).when(F.col("mode") == "append", F.concat_ws("\n\n", "body", "new_body")).otherwise(F.col("body"))
    after = j.select(*(body.alias("body") if c == "body" else F.coalesce("field_topic", "topic").alias("topic") if c == "topic" else F.col(c) for c in entries.columns))
    return after, entries.join(edits.select("doc_id"), "doc_id", "left_semi")


def backup(files: DataFrame, path: str, before: str | None = None) -> int:
    """Files (name, content) that are new or changed since the backup `before`, with a manifest of all names and hashes; how many were written."""
    now = files.select("name", "content", F.sha2("content", 256).alias("hash"))
    fresh_rows = now
    if before:
        fresh_rows = now.join(files.sparkSession.read.parquet(f"{before}/manifest").select("name", "hash"), ["name", "hash"], "left_anti")
    fresh_rows.write.parquet(f"{path}/files")
    now.select("name", "hash").write.parquet(f"{path}/manifest")
    return files.sparkSession.read.parquet(f"{path}/files").count()


def restore(spark: SparkSession, chain: list[str]) -> DataFrame:
    """name, content, intact of the last backup's manifest, from a chain of backups, the full one first; content must have its hash."""
    wanted = spark.read.parquet(f"{chain[-1]}/manifest")
    held = None
    for p in chain:
        part = spark.read.parquet(f"{p}/files")
        held = part if held is None else held.unionByName(part)
    held = held.dropDuplicates(["name", "hash"])
    j = wanted.join(held, ["name", "hash"], "left")
    return j.select("name", "content", F.coalesce(F.sha2("content", 256) == F.col("hash"), F.lit(False)).alias("intact"))


RECORDS = "array<struct<source_record_id:string,content_hash:string,journal:struct<title:string,date:string,topic:string,tags:array<string>,content:string>,attachments:array<struct<attachment_id:string,source_sha256:string,target_rel_path:string,size_bytes:bigint>>>>"


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """The records of import sources (one JSON document a file), one row each, with the adapter that made them."""
    src = spark.read.schema(f"adapter_id string, input_label string, records {RECORDS}").option("multiLine", True).json(path)
    r = src.select("adapter_id", F.explode("records").alias("r"))
    return r.select("adapter_id", "r.source_record_id", "r.content_hash", "r.journal.title", "r.journal.date", "r.journal.tags", F.size("r.attachments").alias("n_attachments"))


def consume_pending(spark: SparkSession, queue: str, schema: str, target: str, checkpoint: str, key: str = "doc_id", version: str = "version") -> DataFrame:
    """Bring target up to date with all pending writes of queue and return its latest rows; deletes are rows with `deleted`.

    The table is kept as levelled runs (runs.py): no batch rewrites it, and reading takes in the few runs that are live.
    """
    from .runs import Runs

    runs = Runs(spark, target, schema, key, version)
    runs.consume(queue, checkpoint)
    return runs.read()

def unique_names(rows: DataFrame, name: str, by: str) -> DataFrame:
    """Adds file_name: a name that was taken before (in order of `by`) gets _2, _3, ... before its extension."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(by))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return rows.withColumn("file_name", F.when(n > 1, F.concat(stem, F.lit("_"), n.cast("string"), ext)).otherwise(F.col(name)))


def byte_range(header: Column, size: Column) -> Column:
    """(start, end) of a `bytes=a-b` request on so many bytes: open ends, the last n bytes; null if it can't be met."""
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", k) for k in (1, 2))
    number = lambda x: F.when(x != "", x).cast("long")
    start = F.when(a != "", number(a)).otherwise(F.greatest(F.lit(0), size - number(b)))
    end = F.when((a != "") & (b != ""), F.least(number(b), size - 1)).otherwise(size - 1)
    ok = header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (start <= end) & (start < size)
    return F.when(ok, F.struct(start.alias("start"), end.alias("end")))


def calendar_docs(entries: DataFrame) -> DataFrame:
    """level, key, doc: a Markdown page for each month, year and the whole, with counts by topic. Years and the whole are summed from months."""
    months = entries.groupBy(F.date_format("date", "yyyy-MM").alias("month"), "topic").agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.array(F.struct(F.lit("month").alias("level"), F.col("month").alias("key")), F.struct(F.lit("year").alias("level"), F.substring("month", 1, 4).alias("key")), F.struct(F.lit("root").alias("level"), F.lit("all").alias("key"))))
    n = months.select(level.alias("k"), "topic", "n").groupBy("k.level", "k.key", "topic").agg(F.sum("n").alias("n"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "topic"))), lambda x: F.concat(F.lit("- "), x["topic"], F.lit(": "), (-x["less"]).cast("string"))), "\n")
    d = n.groupBy("level", "key").agg(F.sum("n").alias("total"), lines.alias("lines"))
    return d.select("level", "key", F.concat(F.lit("# "), "key", F.lit("\n\n"), F.col("total").cast("string"), F.lit(" entries\n\n"), "lines").alias("doc"))
