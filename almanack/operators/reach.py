"""Neighbours of many starts at once, and ids resolved through chains of merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

SALTS = 8
LEAF_SALTS = 32


def all_neighbours(edges: DataFrame, starts: DataFrame, hops: int = 3, hub: int = 1000) -> DataFrame:
    """start, id, hops, relations, sources, targets: every node within `hops` of every start, by its least path (hops, relations, sources, targets).

    edges: source, relation, target, followed both ways; starts: id. The frontier has a row a start and node that the last hop
    reached first. Nodes with more than `hub` edges have them dealt over salts, and only their frontier rows are copied. Each hop is
    written, so a lost executor costs a hop; it stops where nothing new is reached. All least paths of a start with one edge begin
    with it, so such a start isn't followed: it has what its neighbour reaches in a hop less, by one join whose rows go out as they are.
    """
    e = edges.select("source", "relation", "target").distinct()
    way = lambda a, b: e.select(F.col(a).alias("at"), F.col(b).alias("to"), "relation", "source", "target")
    both = way("source", "target").unionByName(way("target", "source"))
    degrees = written(both.groupBy("at").count(), "degrees")
    hubs = degrees.filter(F.col("count") > hub).select(F.col("at"), F.lit(True).alias("hub"))
    both = written(both.join(hubs, "at", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("to"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hub"), "ways")
    none = F.array().cast("array<string>")
    own = starts.filter("id is not null").select(F.col("id").alias("at")).distinct().join(degrees, "at", "left")
    leaves = written(own.filter("count = 1").select("at").join(both, "at").select(F.col("at").alias("leaf"), "to", "relation", "source", "target"), "leaves")
    # `most`: hops of starts that are followed for themselves, one less for those that are followed for leaves only
    followed = own.filter("count is null or count > 1").select("at", F.lit(hops).alias("most")).unionByName(leaves.select(F.col("to").alias("at"), F.lit(hops - 1).alias("most")))
    front = written(followed.groupBy("at").agg(F.max("most").alias("most")).select(F.col("at").alias("start"), F.col("at").alias("id"), "most", none.alias("relations"), none.alias("sources"), none.alias("targets")), "front")
    seen, reached = front.select("start", "id"), None
    add = lambda c, x: F.concat(F.col(c), F.array(x))
    for h in range(1, hops + 1):
        copies = F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        at = front.filter(F.col("most") >= h).withColumnRenamed("id", "at").join(hubs, "at", "left").withColumn("salt", copies).drop("hub")
        near = at.join(both, ["at", "salt"]).select("start", "most", F.col("to").alias("id"), add("relations", "relation").alias("relations"), add("sources", "source").alias("sources"), add("targets", "target").alias("targets"))
        near = near.join(seen, ["start", "id"], "left_anti").groupBy("start", "most", "id").agg(F.min(F.struct("relations", "sources", "targets")).alias("p")).select("start", "id", "most", "p.*")
        front = written(near, "front")
        found = front.withColumn("hops", F.lit(h).cast("long"))
        reached = found if reached is None else reached.unionByName(found)
        seen = seen.unionByName(front.select("start", "id"))
        if h < hops and front.isEmpty():
            break
    columns = ("start", "id", "hops", "relations", "sources", "targets")
    first = leaves.select(F.col("leaf").alias("start"), F.col("to").alias("id"), F.lit(1).cast("long").alias("hops"), *(F.array(c).alias(f"{c}s") for c in ("relation", "source", "target")))
    # leaves of a hub are dealt over salts, and what the hub reaches is copied to each; small as both sides are, their product isn't,
    # so neither is sent to all tasks and partitions aren't put together
    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df, salt: df.withColumn("salt", salt).repartition(n, "to", "salt")
    dealt = deal(leaves, F.pmod(F.xxhash64("leaf"), F.lit(LEAF_SALTS)).cast("int"))
    beyond = deal(reached.filter(F.col("hops") < hops).withColumnRenamed("start", "to"), F.explode(F.sequence(F.lit(0), F.lit(LEAF_SALTS - 1)))).hint("merge")
    before = lambda c: F.concat(F.array(c), F.col(f"{c}s")).alias(f"{c}s")
    rest = dealt.join(beyond, ["to", "salt"]).filter("id <> leaf").select(F.col("leaf").alias("start"), "id", (F.col("hops") + 1).alias("hops"), before("relation"), before("source"), before("target"))
    return reached.filter(F.col("most") == hops).select(*columns).unionByName(first).unionByName(rest)


def active_merges(log: DataFrame) -> DataFrame:
    """id, to, seq: the merges of a log that stand. log: seq, source, target, undoes (the seq of a merge that the row takes back, or null).

    Replay without the merges that were taken back: of one id the first merge counts, as it is gone after that; merges into
    itself, and rows without an id, count for nothing. Taking back an undo isn't known: merge again.
    """
    gone = log.filter("undoes is not null").select(F.col("undoes").alias("seq")).distinct()
    kept = log.filter("undoes is null and source is not null and target is not null and source <> target").join(gone, "seq", "left_anti")
    return kept.groupBy(F.col("source").alias("id")).agg(F.min_by(F.struct(F.col("target").alias("to"), "seq"), "seq").alias("m")).select("id", "m.*")


def resolved(merges: DataFrame) -> DataFrame:
    """id, root: where each merged id ends, through chains of any length, by pointer jumping: a round halves every chain.

    merges: id, to, seq, one row an id (active_merges()). In a ring of merges the last one (by seq) would merge a node into
    itself, and counts for nothing; its id stands.
    """
    link = written(merges.select("id", "to", F.col("seq").alias("last")), "links")
    rounds = link.count().bit_length() + 1  # by then a pointer has gone as many steps as there are merges, and once more to see that it stays
    for _ in range(rounds):
        ahead = link.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("last").alias("later"))
        nxt = link.join(ahead, "to", "left").select("id", F.coalesce("beyond", "to").alias("to"), F.greatest("last", F.coalesce("later", "last")).alias("last"), F.col("beyond").isNotNull().alias("moved"))
        nxt = written(nxt, "links")
        if nxt.filter("moved").isEmpty():
            return nxt.select("id", F.col("to").alias("root"))
        link = nxt.select("id", "to", "last")
    # pointers that still move go round in rings, and point at all nodes of theirs; each of these knows its ring's last merge
    still = link.join(link.select(F.col("id").alias("to")), "to", "left_semi")
    ring = link.join(still.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select(F.col("last").alias("seq")).distinct()
    return resolved(merges.join(ring, "seq", "left_anti"))


def merged_graph(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, aliases) and edges (source, relation, target) after the log's merges: names of those that went are aliases of where they ended."""
    to = resolved(active_merges(log))
    none = F.array().cast("array<string>")
    n = nodes.join(to, "id", "left").select(F.coalesce("root", "id").alias("to"), "id", "name", F.coalesce("aliases", none).alias("aliases"))
    stay = n.filter("id = to").select("id", "name")
    more = n.select("to", F.explode(F.concat(F.when(F.col("id") != F.col("to"), F.array("name")).otherwise(none), "aliases")).alias("alias")).distinct()
    names = more.join(stay.select(F.col("id").alias("to"), "name"), "to").filter("alias <> name").groupBy(F.col("to").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    kept = stay.join(names, "id", "left").select("id", "name", F.coalesce("aliases", none).alias("aliases"))
    end = lambda df, c: df.join(to.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    return kept, end(end(edges, "source"), "target").select("source", "relation", "target").filter("source <> target").distinct()
