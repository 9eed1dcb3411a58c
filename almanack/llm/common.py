"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """The session, with Arrow batches of a thousand texts at most (ten thousand by default): a batch is held by executor and worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/almanack-shared"
    return found.rstrip("/")


_owned: set[str] = set()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, in a folder of this application's own, which goes when the driver ends."""
    own = f"{shared_dir(spark)}/almanack-{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        fs, p = hadoop_path(spark, own)
        atexit.register(_remove, fs, p)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def _remove(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may have ended before; the folder's name tells whose it was
        pass


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it again."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches, rows: int = 256):
    """Arrow batches in slices of a few rows, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def give_back() -> None:
    """Give free memory of this Python process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def frees(run):
    """A worker's function that gives memory back to the system at its end: workers serve one stage after another."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
