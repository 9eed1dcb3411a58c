"""Pairs of similar strings by signatures of segments: no pair of all strings is made.

A string of length L and one at distance d or less: cut the longer into d + 1 segments, and the other has one of them whole,
at most d places away. So the longer is joined by its segments with the other's substrings at those places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies of a hot segment's side, over which the other side's rows are dealt.
SALTS = 8


def similar_pairs(strings: DataFrame, least: float = 0.85, most_gap: int = 2, column: str = "name", hot: int = 1000) -> DataFrame:
    """a, b (a < b), distance, similarity of the different strings of a column with 1 - distance / longer length of `least` or more and
    lengths `most_gap` apart at most. Exact. Nulls and empty strings are in no pair.

    Segments that more than `hot` strings have are split over salts. Equal strings are one string here; join the classes' members if wanted.
    """
    s = strings.select(F.col(column).cast("string").alias("s")).filter("length(s) > 0").distinct().withColumn("len", F.length("s"))
    errors = lambda length: F.floor((1.0 - least) * length + 1e-9).cast("int")
    # the longer: segment i of d + 1 begins after the shares of those before it; the last ones are a character longer
    longer = s.withColumn("d", errors(F.col("len"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    short, extra = F.floor(F.col("len") / (F.col("d") + 1)), F.col("len") % (F.col("d") + 1)
    plain = F.col("d") + 1 - extra  # segments of the shorter kind
    begin = (F.col("i") * short + F.greatest(F.lit(0), F.col("i") - plain)).cast("int")
    size = (short + F.when(F.col("i") >= plain, 1).otherwise(0)).cast("int")
    longer = longer.select(F.col("s").alias("x"), F.col("len").alias("long"), "i", F.substring("s", begin + 1, size).alias("part"))
    # the other: what it would share with a longer one of each length
    other = s.withColumn("long", F.explode(F.sequence(F.col("len"), F.col("len") + most_gap))).withColumn("d", errors(F.col("long")))
    other = other.filter(F.col("long") - F.col("len") <= F.col("d")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    short, extra = F.floor(F.col("long") / (F.col("d") + 1)), F.col("long") % (F.col("d") + 1)
    plain = F.col("d") + 1 - extra
    begin = (F.col("i") * short + F.greatest(F.lit(0), F.col("i") - plain)).cast("int")
    size = (short + F.when(F.col("i") >= plain, 1).otherwise(0)).cast("int")
    low, high = F.greatest(F.lit(0), begin - F.col("d")), F.least(begin + F.col("d"), F.col("len") - size)
    places = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    other = other.withColumn("_size", size).withColumn("at", F.explode(places)).select(F.col("s").alias("y"), "len", "long", "i", F.substring("s", F.col("at") + 1, F.col("_size")).alias("part")).distinct()
    key = ["long", "i", "part"]
    heavy = longer.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).drop("n").withColumn("heavy", F.lit(True))
    copies = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = longer.join(heavy, key, "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("heavy")
    right = other.join(heavy, key, "left").withColumn("salt", F.explode(copies)).drop("heavy")
    # of one length either may count as the longer; one order is enough
    near = left.join(right, [*key, "salt"]).filter((F.col("long") > F.col("len")) | (F.col("x") > F.col("y")))
    pairs = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    pairs = pairs.withColumn("distance", F.levenshtein("a", "b", 1 << 20)).filter(1 - F.col("distance") / longest >= least - 1e-9)
    return pairs.select("a", "b", "distance", F.round(1 - F.col("distance") / longest, 4).alias("similarity"))
