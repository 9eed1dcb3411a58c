"""Names of a dictionary in texts, for dictionaries of any size.

Texts and names are cut into the same pieces: runs of ASCII letters, digits and _, and every other character but white
space. A name occurs where its pieces follow each other; so an ASCII name never matches within a longer word, and white
space between pieces may vary. The dictionary is a table of forms (names of the same pieces are one). A place of a text is kept
if its piece begins a form, and joined, for each length of the forms that begin so, on a hash of as many pieces as the form
has; so however many names begin alike, a place meets only those that it holds. Of overlapping occurrences the longest stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

PIECE = r"[a-z0-9_]+|[^a-z0-9_\s]"


def pieces(col):
    return F.regexp_extract_all(F.lower(col), F.lit(PIECE), 0)


def _forms(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(form, own, n, size: the forms by number, with their pieces, how many these are and the characters of the longest name;
    form, name, entity_id: the names of each). Blank and null names have none."""
    d = names.select("entity_id", F.lower("name").alias("name"), pieces("name").alias("own")).filter("size(own) > 0").distinct()
    forms = d.groupBy("own").agg(F.max(F.length("name")).alias("size")).select(F.monotonically_increasing_id().alias("form"), "own", F.size("own").alias("n"), "size")
    forms = written(forms, "forms")
    return forms, d.join(forms.select("form", "own"), "own").select("form", "name", "entity_id")


def _hits(texts: DataFrame, forms: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The columns to keep, start, form, n, size of each place where a form stands. Spark broadcasts forms where their size allows,
    else both sides are dealt out by hash, hot ones split by its skew join."""
    heads = written(forms.groupBy(F.col("own")[0].alias("head")).agg(F.collect_set("n").alias("ns")), "heads")
    most = forms.agg(F.max("n").alias("most"))  # one row
    t = texts.select(*keep, pieces(text_col).alias("all")).filter("size(all) > 0").crossJoin(F.broadcast(most)).filter("most is not null")
    # a place carries no more pieces than the longest form has, and these are copied only where a form begins
    rows = t.select(*keep, "all", "most", F.posexplode("all").alias("start", "head")).select(*keep, "start", "head", F.slice("all", F.col("start") + 1, F.col("most")).alias("ahead")).join(heads, "head")
    rows = rows.select(*keep, "start", "ahead", F.explode("ns").alias("n")).filter(F.col("n") <= F.size("ahead")).select(*keep, "start", F.slice("ahead", F.lit(1), F.col("n")).alias("own"))
    found = rows.withColumn("key", F.xxhash64("own")).join(forms.withColumnRenamed("own", "_own").withColumn("key", F.xxhash64("_own")), "key")
    return found.filter("own = _own").select(*keep, "start", "form", "n", "size")


def occurrences(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, start, n (pieces), size (characters of the name), name, entity_id of every occurrence, overlapping or not.

    names: entity_id, name; blank and null names occur nowhere.
    """
    forms, said = _forms(names)
    return _hits(texts, forms, text_col, id_col).drop("size").join(said, "form").select(id_col, "start", "n", F.length("name").alias("size"), "name", "entity_id")


def longest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of occurrences() that stay: the longest (in characters; then the first) of those that overlap, then the longest of the rest, and so on.

    Occurrences are swept into runs of overlapping ones, and each run is settled by itself, so a group is as large as a run of
    overlaps and not as a text. Entities of one name at one place all stay.
    """
    chosen = _longest(found.groupBy(id_col, "start", "n").agg(F.max("size").alias("size")).withColumn("form", F.lit(0).cast("long")), id_col)
    return found.join(chosen, [id_col, "start", "n"], "left_semi")


def _longest(spans: DataFrame, id_col: str) -> DataFrame:
    """id_col, start, n, form of the spans (id_col, start, n, size, form; one a place and number of pieces) that stay. One shuffle, by id."""
    before = Window.partitionBy(id_col).orderBy("start", F.desc("n"))
    reach = F.max(F.col("start") + F.col("n")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("long")).withColumn("run", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "start", "n", "form")))
    free = lambda held, s: ~F.exists(held, lambda h: (h["start"] < s["start"] + s["n"]) & (s["start"] < h["start"] + h["n"]))
    none = F.array().cast("array<struct<less:int,start:int,n:int,form:long>>")
    kept = F.aggregate("ordered", none, lambda held, s: F.when(free(held, s), F.concat(held, F.array(s))).otherwise(held))
    groups = runs.groupBy(id_col, "run").agg(ordered.alias("ordered"))
    return groups.select(id_col, F.inline(F.when(F.size("ordered") == 1, F.col("ordered")).otherwise(kept))).select(id_col, "start", "n", "form")


def embedded_names(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, entity_id, n: how often an entity's names stand in a text, longest names first, none overlapping.

    Places are settled and counted by form; entities come in at the end.
    """
    forms, said = _forms(names)
    times = _longest(_hits(texts, forms, text_col, id_col), id_col).groupBy(id_col, "form").agg(F.count(F.lit(1)).alias("times"))
    of = written(said.groupBy("form", "entity_id").agg(F.count(F.lit(1)).alias("names")), "names")
    return times.join(of, "form").groupBy(id_col, "entity_id").agg(F.sum(F.col("times") * F.col("names")).alias("n"))


def mentions_of(entries: DataFrame, names: DataFrame, most: int = 20, text_col: str = "body") -> DataFrame:
    """entity_id, doc_id, date, place: the newest `most` entries that hold any name of an entity (overlaps don't matter), each once.

    The newest are chosen by form first, in the tasks before the shuffle: those of an entity are among those of its forms.
    """
    forms, said = _forms(names)
    newest = Window.partitionBy("form").orderBy(F.desc("date"), F.desc("doc_id"))
    held = _hits(entries.filter("doc_id is not null"), forms, text_col, "doc_id", "date").select("form", "doc_id", "date")
    held = held.withColumn("place", F.dense_rank().over(newest)).filter(F.col("place") <= most).select("form", "doc_id", "date").distinct()
    held = held.join(said.select("form", "entity_id").distinct(), "form").select("entity_id", "doc_id", "date").distinct()
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("date"), F.desc("doc_id")))
    return held.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("entity_id", "doc_id", "date", "place")
