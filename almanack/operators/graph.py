"""Entity graph: lookup, neighbours, audits and candidate edges."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .order import numbered


def neighbours(edges: DataFrame, start: str, hops: int = 3) -> DataFrame:
    """id, hops, path (relations of the best path): edges are followed both ways, cycles are cut by the best hop count.

    Each hop is one join of a frontier with the edges; a node keeps its best path only, so frontiers stay small.
    """
    both = edges.select("source", "relation", "target").unionByName(edges.select(F.col("target").alias("source"), "relation", F.col("source").alias("target")))
    front = edges.sparkSession.createDataFrame([(start, 0, "")], "id string, hops long, path string")
    best = front
    w = Window.partitionBy("id").orderBy("hops", "path")
    for h in range(1, hops + 1):
        step = both.join(front.filter(F.col("hops") == h - 1), both.source == front.id).select(F.col("target").alias("id"), F.lit(h).cast("long").alias("hops"), F.concat_ws(">", F.when(F.col("path") != "", F.col("path")), "relation").alias("path"))
        best = best.unionByName(step).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
        front = best
    return best.filter(F.col("id") != start)


def paths(edges: DataFrame, start: str, hops: int = 1, relations: list[str] | None = None, most: int = 50) -> DataFrame:
    """id, hops, relations, sources, targets, place of the `most` nearest nodes: of a node's paths the least by hops, relations, sources, targets.

    Edges of the given relations (or all) are followed both ways. A hop joins the nodes that the last one reached first with
    the edges; each node keeps one path, so a frontier has a row a node at most.
    """
    e = edges.filter(F.col("relation").isin(relations)) if relations else edges
    e = e.select("source", "relation", "target").distinct()
    way = lambda a, b: e.select(F.col(a).alias("at"), F.col(b).alias("to"), "relation", "source", "target")
    both = way("source", "target").unionByName(way("target", "source"))
    none = F.array().cast("array<string>")
    front = edges.sparkSession.range(1).select(F.lit(start).alias("id"), none.alias("relations"), none.alias("sources"), none.alias("targets"))
    reached, seen = None, front.select("id")
    for h in range(1, hops + 1):
        add = lambda c, x: F.concat(F.col(c), F.array(x))
        near = both.join(front, both["at"] == front["id"]).select(F.col("to").alias("id"), add("relations", "relation").alias("relations"), add("sources", "source").alias("sources"), add("targets", "target").alias("targets"))
        near = near.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("relations", "sources", "targets")).alias("p")).select("id", "p.*")
        found = near.withColumn("hops", F.lit(h).cast("long"))
        reached, seen, front = (found if reached is None else reached.unionByName(found)), seen.union(near.select("id")), near
    first = reached.orderBy("hops", "relations", "sources", "targets", "id").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy("hops", "relations", "sources", "targets", "id")).cast("long"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti")


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """name (lower case), n, first_id of names that several nodes have."""
    return nodes.groupBy(F.lower("name").alias("name")).agg(F.countDistinct("id").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def near_names(nodes: DataFrame) -> DataFrame:
    """Pairs of names at Levenshtein distance 1 at most, by join keys: the name, and the name without each one letter.

    Names at distance 1 or less have such a key in common, so no pair of all nodes is made.
    """
    n = nodes.select("id", F.lower("name").alias("name")).filter(F.length("name") > 2)
    cut = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.substring("name", i + 1, F.length("name"))))
    k = n.select("id", "name", F.explode(F.array_distinct(F.concat(F.array("name"), cut))).alias("key"))
    x, y = k.select("key", F.col("id").alias("id1"), F.col("name").alias("name1")), k.select("key", F.col("id").alias("id2"), F.col("name").alias("name2"))
    return x.join(y, "key").filter("id1 < id2 and levenshtein(name1, name2) <= 1").select("id1", "id2").distinct()


def cooccurrence(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """a, b, n_groups, confidence, action of pairs of values that share a group; values are distinct within one."""
    d = rows.select(*group, value).distinct()
    x, y = d.withColumnRenamed(value, "a"), d.withColumnRenamed(value, "b")
    n = x.join(y, group).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_groups"))
    return n.select("a", "b", "n_groups", F.round(F.least(F.lit(1.0), F.col("n_groups") / 5), 4).alias("confidence"), F.when(F.col("n_groups") >= 3, "confirm").when(F.col("n_groups") == 2, "review").otherwise("low").alias("action"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, n, n_out, n_in."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    j = nodes.join(out, "id", "left").join(into, "id", "left")
    return j.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_out"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_in"))


def issues(*frames: tuple[str, str, DataFrame]) -> DataFrame:
    """(category, risk, ids) frames as one queue, by risk, category and id."""
    all_of = reduce(DataFrame.unionByName, (f.select(F.lit(c).alias("category"), F.lit(r).alias("risk"), F.col("id")) for c, r, f in frames))
    level = F.when(F.col("risk") == "high", 1).when(F.col("risk") == "medium", 2).otherwise(3)
    return numbered(all_of.withColumn("_level", level), "place", "_level", "category", "id").drop("_level")


def related(entries: DataFrame, points: dict[str, int], days: int = 30, most: int = 5, small: int = 64) -> DataFrame:
    """doc_id, related, score, place: for each entry the `most` others of highest score, then the nearest, then the greater id.

    entries: doc_id (unique), date (not null) and the columns of `points`. A column with the same value in both adds its
    points, nulls are never the same; a distance of up to `days` adds 10 less the days, 1 at least; at score 0 there is no
    relation. Exact without making all pairs. Values of at most `small` entries are blocks compared in whole. Of the entries that
    share just some set of more frequent values with one, only the `most` nearest can be among its best: such a block shows an
    entry the greatest ids of its own date and of the `most` dates before and after. An entry sees the block of all its frequent
    values first, and those of fewer only where their points could still reach its last place.
    """
    cols = list(points)
    e = written(entries.select("doc_id", "date", *cols), "related")
    for k in cols:
        often = written(e.filter(F.col(k).isNotNull()).groupBy(k).count().filter(F.col("count") > small).select(k, F.lit(True).alias(f"_{k}")), "often")
        e = e.join(often, k, "left").withColumn(f"_{k}", F.coalesce(f"_{k}", F.lit(False)))
    e = written(e, "related")
    score = lambda p, dist: (p + F.when(dist <= days, F.greatest(F.lit(1), 10 - F.least(dist, F.lit(9)))).otherwise(0)).cast("int")
    place = lambda s, dist, i: F.struct((-s).alias("s"), dist.alias("dist"), (-i).alias("minus"))
    sets = [c for n in range(len(cols), -1, -1) for c in combinations(cols, n)]
    worth = lambda c: sum(points[k] for k in c)
    of = F.concat_ws(",", *(F.when(F.col(f"_{k}"), F.lit(k)) for k in cols))
    holds = lambda c: reduce(lambda x, y: x & y, (F.col(f"_{k}") for k in c), F.lit(True))
    block = lambda c: F.when(holds(c), F.struct(F.lit(worth(c)).alias("points"), F.to_json(F.struct(F.lit(",".join(c)).alias("of"), *c)).alias("key")))

    def rare(k: str) -> DataFrame:
        """The best of those with the same rare value of a column."""
        g = e.filter(F.col(k).isNotNull() & ~F.col(f"_{k}")).groupBy(k).agg(F.collect_list(F.struct("doc_id", "date", *cols)).alias("g")).filter("size(g) > 1")
        g = g.select(F.explode("g").alias("a"), "g")
        same = lambda x: reduce(lambda p, q: p + q, (F.when(x[c] == F.col("a")[c], points[c]).otherwise(0) for c in cols))
        dist = lambda x: F.abs(F.datediff(F.col("a")["date"], x["date"]))
        others = F.transform(F.filter("g", lambda x: x["doc_id"] != F.col("a")["doc_id"]), lambda x: place(score(same(x), dist(x)), dist(x), x["doc_id"]))
        return g.select("a.doc_id", F.slice(F.sort_array(others), 1, most).alias("best"))

    def frequent(asks: DataFrame, shown: list) -> DataFrame:
        """The nearest in the blocks that are asked for (doc_id, date, points, key), which are of the sets shown."""
        rows = e.select("doc_id", "date", F.explode(F.array_compact(F.array(*map(block, shown)))).alias("b")).select("doc_id", "date", "b.key")
        top = rows.withColumn("n", F.row_number().over(Window.partitionBy("key", "date").orderBy(F.desc("doc_id")))).filter(F.col("n") <= most + 1)
        dates = top.groupBy("key", "date").agg(F.collect_list("doc_id").alias("ids"))
        near = dates.select("key", "date", F.collect_list(F.struct("date", "ids")).over(Window.partitionBy("key").orderBy("date").rowsBetween(-most, most)).alias("near"))
        seen = F.flatten(F.transform("near", lambda d: F.transform(d["ids"], lambda i: F.struct(F.abs(F.datediff(F.col("date"), d["date"])).alias("dist"), (-i).alias("minus")))))
        near = near.select("key", "date", F.slice(F.sort_array(seen), 1, most + 1).alias("near"))  # one of them may be the entry itself
        best = F.slice(F.filter("near", lambda x: x["minus"] != -F.col("doc_id")), 1, most)
        return asks.join(near, ["key", "date"]).select("doc_id", F.transform(best, lambda x: place(score(F.col("points"), x["dist"]), x["dist"], -x["minus"])).alias("best"))

    def joined(parts: list[DataFrame]) -> DataFrame:
        """Lists of one entry as one; of one id the highest score."""
        ordered = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("best")))).alias("all"))
        return ordered.select("doc_id", F.slice(F.filter("all", lambda x, i: F.array_position(F.col("all")["minus"], x["minus"]) == i + 1), 1, most).alias("best"))

    present = [tuple(x for x in r.of.split(",") if x) for r in e.select(of.alias("of")).distinct().collect()]  # no more than there are sets
    if not present:
        return e.select("doc_id", F.col("doc_id").alias("related"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("place"))
    own = F.coalesce(*(F.when(of == ",".join(c), block(c)) for c in present))
    asks = e.select("doc_id", "date", own.alias("b")).select("doc_id", "date", "b.points", "b.key")
    first = written(joined([*(rare(k) for k in cols), frequent(asks, present)]), "best")
    last = F.when(F.size("best") >= most, -F.col("best")[most - 1]["s"]).otherwise(0)
    open_ = e.join(first.select("doc_id", last.alias("last")), "doc_id", "left").filter(F.coalesce("last", F.lit(0)) <= max((worth(c) for c in sets if c not in present or len(present) > 1), default=-11) + 10)
    may = lambda c: F.when((of != ",".join(c)) & (F.coalesce("last", F.lit(0)) <= worth(c) + 10), block(c))
    asks = written(open_.select("doc_id", "date", F.explode(F.array_compact(F.array(*map(may, sets)))).alias("b")).select("doc_id", "date", "b.points", "b.key"), "asks")
    shown = [c for c in sets if not asks.filter(F.get_json_object("key", "$.of") == ",".join(c)).isEmpty()]
    found = joined([first, frequent(asks, shown)]) if shown else first
    return found.select("doc_id", F.posexplode("best").alias("k", "x")).filter("x.s < 0").select("doc_id", (-F.col("x.minus")).alias("related"), (-F.col("x.s")).cast("long").alias("score"), (F.col("k") + 1).cast("long").alias("place"))
