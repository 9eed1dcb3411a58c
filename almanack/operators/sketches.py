"""Exact answers by way of mergeable summaries: percentiles over rolling days, and the most frequent terms."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Bins an octave of a value's size.
PER_OCTAVE = 64


def bin_of(value):
    """Number of a value's bin: the same order as the values; sixty-four bins an octave on either side of nought."""
    size = F.floor(F.log2(F.abs(value)) * PER_OCTAVE).cast("int") + 100_000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)


def rolling_percentile(rows: DataFrame, share: float = 0.95, days: int = 7, day: str = "date", value: str = "value") -> DataFrame:
    """day, n, value: of each day that has a row, the nearest-rank percentile (the ceil(share n)-th least) of the `days` days up to it.

    A day's sketch counts values by bin; sketches of the days are added up for each end, which tells the bin that holds the rank and
    the rank within it. One more pass ranks the values of that bin alone, as counts of different values. Exact; what is held for an
    end is bounded by bins and not by rows. Null values and days are left out.
    """
    own = rows.select(F.col(day).cast("date").alias("day"), F.col(value).cast("double").alias("value")).filter("day is not null and value is not null and not isnan(value)").withColumn("bin", bin_of(F.col("value")))
    sketch = written(own.groupBy("day", "bin").agg(F.count(F.lit(1)).alias("n")), "sketch")
    ends = sketch.select(F.col("day").alias("end")).distinct()
    till = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("day", k))).alias("end")
    merged = sketch.select(till, "bin", "n").join(ends, "end", "left_semi").groupBy("end", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("end")
    place = merged.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))}).withColumn("rank", F.ceil(F.col("total") * share - 1e-9))
    bracket = written(place.filter("upto >= rank and upto - n < rank").select("end", "bin", "total", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank")), "bracket")
    wanted = bracket.select("end", "bin", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_sub("end", k))).alias("day"))
    inside = own.groupBy("day", "bin", "value").agg(F.count(F.lit(1)).alias("n")).join(wanted, ["day", "bin"]).groupBy("end", "value").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("end").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upto", upto).join(bracket.select("end", "total", "rank"), "end").filter("upto >= rank and upto - n < rank")
    return ranked.select(F.col("end").alias("day"), F.col("total").alias("n"), "value")


def nearest_rank(rows: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """One row: value, the ceil(share n)-th least of a column's non-null values, null if there are none. Counts by bin, then of the values of one bin."""
    own = rows.select(F.col(value).cast("double").alias("value")).filter("value is not null and not isnan(value)").withColumn("bin", bin_of(F.col("value")))
    counts = own.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    place = counts.withColumns({"upto": F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy())})
    bracket = place.withColumn("rank", F.ceil(F.col("total") * share - 1e-9)).filter("upto >= rank and upto - n < rank").select("bin", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
    inside = own.join(F.broadcast(bracket), "bin").groupBy("value", "rank").agg(F.count(F.lit(1)).alias("n"))  # one bin's row
    upto = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("upto", upto).filter("upto >= rank").agg(F.min("value").alias("value"))


def _summaries(most: int):
    """Misra and Gries: a task's counters, at most `most`; each is short of the truth by the task's `short` at most, as is a term without one."""

    def run(batches):
        held: Counter = Counter()
        short = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for terms in whole.column(0).slice(at, 256).to_pylist():
                    held.update(terms or ())
                if len(held) > most:  # take off as much as leaves `most` counters
                    cut = sorted(held.values(), reverse=True)[most]
                    short += cut
                    held = Counter({t: n - cut for t, n in held.items() if n > cut})
        rows = [*held.items(), (None, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64()), pa.array([0] * len(held) + [short], pa.int64())], names=["term", "least", "short"])

    return run


def top_terms(rows: DataFrame, k: int = 5000, column: str = "terms", most: int = 100_000) -> DataFrame:
    """term, df of the k terms that most rows have, ties by the term. rows: an array of different terms each. Exact.

    Each task sums its rows up in `most` counters (Misra and Gries, 1982); only these are shuffled. A term's count is at most its summed
    counters and the tasks' shortfalls; terms that could reach the k-th best of the lower bounds are counted again over all rows.
    Where the shortfalls alone reach it, a term without any counter might belong there: counters are doubled and all is done again.
    """
    while True:
        told = written(rows.select(column).mapInArrow(_summaries(most), "term string, least long, short long"), "summaries")
        short = told.agg(F.coalesce(F.sum("short"), F.lit(0)).alias("s")).collect()[0].s
        bounds = written(told.filter("term is not null").groupBy("term").agg(F.sum("least").alias("least")), "bounds")
        if short == 0:  # nothing was taken off: counts are exact
            return bounds.select("term", F.col("least").alias("df")).orderBy(F.desc("df"), "term").limit(k)
        best = bounds.orderBy(F.desc("least")).limit(k).agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")).collect()[0]
        if best.n == k and short < best.least:
            break
        most *= 2
    chosen = bounds.filter(F.col("least") + short >= best.least).select("term")
    # candidates are joined to the rows' terms; counts are summed in the tasks before they are shuffled
    counts = rows.select(F.explode(column).alias("term")).join(chosen, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.orderBy(F.desc("df"), "term").limit(k)
