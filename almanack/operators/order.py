"""Places in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """Adds name = 1, 2, ... by the given order: rows are dealt out by ranges of it, numbered within each, and moved up by the counts of the
    ranges before. No task has all rows; rows that tie in everything share one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")
