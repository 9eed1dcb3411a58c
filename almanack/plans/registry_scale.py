"""Queries of operators made for any number of rows, names, starts and batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import names as M
from ..operators import reach as H
from ..operators import segment as G
from ..operators import similar as L
from ..operators import sketches as K
from ..sources import adapters as D
from ..sources.hash_tree import HashTree, changes
from ..sources.runs import Runs
from ..sources.store import fresh, written
from ..streaming import silence
from .registry import EDGES, query


# levelled runs --------------------------------------------------------------------------------------------------------
_ROW = "o_orderkey long, status string, price double, version long, deleted boolean"


@query("""SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 1 WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price,
CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 4 WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS version FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus <> 'P'""")
def t1_t2_k3_levelled_runs(spark, d):
    """A history made from orders, in four batches: all; finished ones dearer; pending ones deleted; urgent ones cheaper, deleted ones among them."""
    o = D.table(spark, d, "orders")
    row = lambda rows, price, version, gone=False: rows.select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") + price).alias("price"), F.lit(version).cast("long").alias("version"), F.lit(gone).alias("deleted"))
    queue, checkpoint = fresh(spark, "queue"), fresh(spark, "runs-checkpoint")
    runs = Runs(spark, fresh(spark, "runs"), _ROW, "o_orderkey", fanout=2)
    for part in (row(o, 0.0, 1), row(o.filter("o_orderstatus = 'F'"), 1.0, 2), row(o.filter("o_orderstatus = 'P'"), 0.0, 3, True), row(o.filter("o_orderpriority = '1-URGENT'"), -1.0, 4)):
        part.write.mode("append").parquet(queue)
        runs.consume(queue, checkpoint)  # all files that came are a batch
    return runs.read()


# names ----------------------------------------------------------------------------------------------------------------
_LINE = "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"


@query(f"""WITH r AS (SELECT l_orderkey AS doc_id, unnest(['part:' || p_name, 'brand:' || p_brand, 'supplier:' || s_suppkey, 'kind:' || string_split(p_name, ' ')[2]]) AS entity_id FROM {_LINE})
SELECT doc_id, entity_id, count(*) AS n FROM r GROUP BY ALL""")
def j5_g9_names_of_a_table(spark, d):
    """Names of parts, brands, suppliers and kinds in a text for each order; kinds stand by themselves and within parts' names, some brands begin as others do."""
    p, s = D.table(spark, d, "part"), D.table(spark, d, "supplier")
    kind = F.split("p_name", " ")[1]
    of = lambda df, what, name, key=None: df.select(F.concat(F.lit(f"{what}:"), (name if key is None else key).cast("string")).alias("entity_id"), name.alias("name"))
    names = of(p, "part", F.col("p_name")).unionByName(of(p, "brand", F.col("p_brand"))).unionByName(of(p, "kind", kind)).unionByName(of(s, "supplier", F.col("s_name"), F.col("s_suppkey"))).distinct()
    lines = D.table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    said = F.concat(F.initcap("p_name"), F.lit(" ("), "p_brand", F.lit(") by "), "s_name", F.lit(", a "), kind, F.lit("."))
    texts = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(said)), " ").alias("text"))  # an order has a few lines
    return M.embedded_names(texts, names)


@query(f"""WITH r AS (SELECT DISTINCT 'supplier:' || s_suppkey AS entity_id, l_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS date FROM {_LINE} JOIN orders ON l_orderkey = o_orderkey)
SELECT entity_id, doc_id, CAST(date AS VARCHAR) AS day, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC, doc_id DESC) AS place FROM r QUALIFY place <= 20""")
def j22_mentions_of_a_table(spark, d):
    """The twenty newest orders whose text names a supplier."""
    s, o = D.table(spark, d, "supplier"), D.table(spark, d, "orders")
    lines = D.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    texts = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("from "), "s_name"))), "; ").alias("body"))
    entries = texts.join(o, F.col("doc_id") == F.col("o_orderkey")).select("doc_id", "body", F.to_date("o_orderdate").alias("date"))
    found = M.mentions_of(entries, s.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("name")))
    return found.select("entity_id", "doc_id", F.col("date").cast("string").alias("day"), "place")


# similar strings ------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT DISTINCT p_name || ' ' || p_brand AS s FROM part), p AS (SELECT a.s AS a, b.s AS b, levenshtein(a.s, b.s) AS d FROM s a JOIN s b ON a.s < b.s AND abs(length(a.s) - length(b.s)) <= 2)
SELECT a, b, CAST(d AS INTEGER) AS distance, round(1 - d::DOUBLE / greatest(length(a), length(b)), 4) AS similarity FROM p WHERE 1 - d::DOUBLE / greatest(length(a), length(b)) >= 0.85 - 1e-9""")
def j10_r21_f4_similar_names(spark, d):
    """All pairs of names of branded parts with a similarity of 0.85 or more."""
    return L.similar_pairs(D.table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")))


# graph ----------------------------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT source AS at, target AS to_, relation, source, target FROM e0 UNION ALL SELECT target, source, relation, source, target FROM e0),
w AS (SELECT id AS start, id, 0::BIGINT AS hops, []::VARCHAR[] AS rs, []::VARCHAR[] AS ss, []::VARCHAR[] AS ts FROM (SELECT source AS id FROM e0 UNION SELECT target FROM e0 WHERE target LIKE 'nation%')
UNION ALL SELECT start, to_, hops + 1, list_append(rs, relation), list_append(ss, source), list_append(ts, target) FROM w JOIN b ON b.at = w.id WHERE hops < 3)
SELECT start, id, hops, array_to_string(rs, '>') AS relations, array_to_string(ss, '>') AS sources, array_to_string(ts, '>') AS targets FROM w WHERE id <> start QUALIFY row_number() OVER (PARTITION BY start, id ORDER BY hops, rs, ss, ts) = 1""")
def j7_g2_neighbours_of_all(spark, d):
    """Every nation and supplier with all that is three hops away or less."""
    edges = D.edges(spark, d)
    starts = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")).filter("id like 'nation%'")).distinct()
    found = H.all_neighbours(edges, starts, 3)
    return found.select("start", "id", "hops", *(F.array_join(c, ">").alias(c) for c in ("relations", "sources", "targets")))


_MERGES = """m0 AS (SELECT s_suppkey AS seq, s_suppkey AS source, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS target, s_acctbal FROM supplier),
m1 AS (SELECT source, target FROM m0 WHERE target IS NOT NULL AND s_acctbal < 5000 AND s_acctbal >= 0)"""


def _merge_log(spark, d):
    """Suppliers merged into the one before them in their nation, so in chains; merges of those in debt are taken back later."""
    s = D.table(spark, d, "supplier").withColumn("before", F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).filter("before is not null and s_acctbal < 5000")
    key = lambda c: F.concat(F.lit("supplier-"), F.col(c).cast("string"))
    done = s.select(F.col("s_suppkey").alias("seq"), key("s_suppkey").alias("source"), key("before").alias("target"), F.lit(None).cast("long").alias("undoes"))
    back = s.filter("s_acctbal < 0").select((-1 - F.col("s_suppkey")).alias("seq"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.col("s_suppkey").alias("undoes"))
    return done.unionByName(back)


@query(f"""WITH RECURSIVE {_MERGES}, w AS (SELECT source AS id, target AS root, 1 AS n FROM m1 UNION ALL SELECT w.id, m1.target, n + 1 FROM w JOIN m1 ON m1.source = w.root)
SELECT 'supplier-' || id AS id, 'supplier-' || arg_max(root, n) AS root FROM w GROUP BY w.id""")
def g8_merge_chains_with_undo(spark, d):
    return H.resolved(H.active_merges(_merge_log(spark, d)))


@query(f"""WITH RECURSIVE {_MERGES}, {EDGES}, w AS (SELECT source AS id, target AS root, 1 AS n FROM m1 UNION ALL SELECT w.id, m1.target, n + 1 FROM w JOIN m1 ON m1.source = w.root),
r AS (SELECT 'supplier-' || id AS id, 'supplier-' || arg_max(root, n) AS root FROM w GROUP BY w.id),
n AS (SELECT 'supplier-' || s_suppkey AS id, s_name AS name FROM supplier), a AS (SELECT root, string_agg(name, ',' ORDER BY name) AS aliases, count(*) AS n FROM n JOIN r USING (id) GROUP BY root),
g AS (SELECT DISTINCT coalesce(x.root, source) AS source, target FROM e0 LEFT JOIN r x ON x.id = source WHERE relation = 'lives_in')
SELECT n.id, n.name, coalesce(aliases, '') AS aliases, count(g.target) AS n_edges FROM n LEFT JOIN a ON a.root = n.id LEFT JOIN g ON g.source = n.id WHERE n.id NOT IN (SELECT id FROM r) GROUP BY ALL""")
def g8_merged_graph_of_chains(spark, d):
    """Suppliers that are left after the merges, with the names of those they took in and their edges."""
    nodes = D.entities(spark, d).filter("id like 'supplier-%'").select("id", "name", F.array().cast("array<string>").alias("aliases"))
    kept, edges = H.merged_graph(nodes, D.edges(spark, d).filter("relation = 'lives_in'"), _merge_log(spark, d))
    n = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return kept.join(n, "id", "left").select("id", "name", F.array_join("aliases", ",").alias("aliases"), F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


# hash trees -----------------------------------------------------------------------------------------------------------
@query("""WITH z AS (SELECT max(o_orderdate) AS last, max(o_orderkey) AS top FROM orders)
SELECT o_orderkey AS key, 'removed' AS change FROM orders, z WHERE o_orderdate = last UNION ALL SELECT o_orderkey, 'changed' FROM orders, z WHERE o_custkey = 7 AND o_orderdate <> last
UNION ALL SELECT o_orderkey + top + 1, 'added' FROM orders, z WHERE o_custkey = 8""")
def a29_u7_k7_changed_keys(spark, d):
    """Orders against a later version (the last day's gone, one customer's dearer, another's ordered again), by hash trees: the second made from the first."""
    o = D.table(spark, d, "orders")
    last, top = o.agg(F.max("o_orderdate").alias("last"), F.max("o_orderkey").alias("top")).collect()[0]
    gone = F.col("o_orderdate") == F.lit(last)
    price = F.when(F.col("o_custkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    again = o.filter("o_custkey = 8").withColumn("o_orderkey", F.col("o_orderkey") + F.lit(top + 1))
    new = o.filter(~gone).withColumn("o_totalprice", price).unionByName(again)
    old_tree = HashTree(spark, fresh(spark, "tree")).build(o, "o_orderkey")
    touched = o.filter(gone | (F.col("o_custkey") == 7)).select(F.col("o_orderkey").alias("key")).unionByName(again.select(F.col("o_orderkey").alias("key")))
    new_tree = old_tree.updated(fresh(spark, "tree"), new, "o_orderkey", touched)
    return changes(o, new, "o_orderkey", old_tree, new_tree)


# summaries ------------------------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, value FROM events), r AS (SELECT x.day, e.value, row_number() OVER (PARTITION BY x.day ORDER BY e.value) AS k, count(*) OVER (PARTITION BY x.day) AS n FROM (SELECT DISTINCT day FROM e) x JOIN e ON e.day BETWEEN x.day - 6 AND x.day)
SELECT CAST(day AS VARCHAR) AS day, n, value FROM r WHERE k = (95 * n + 99) // 100""")
def a18_t9_rolling_p95(spark, d):
    """The nearest-rank 95th percentile of each day's last seven."""
    return K.rolling_percentile(D.event_entries(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(*) AS df FROM t WHERE length(term) >= 3 GROUP BY term ORDER BY df DESC, term LIMIT 5000""")
def a8_term_menu_of_summaries(spark, d):
    words = F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda w: F.length(w) >= 3)
    return K.top_terms(D.table(spark, d, "documents").select(words.alias("terms")), 5000)


@query()
def r1_segmentation(spark, d):
    """Documents without their spaces, cut again by a dictionary of their words: how many words come out right, by language."""
    # dealt out first: a file's parts may be few and unlike, and the cutting takes long
    docs = D.table(spark, d, "documents").select("doc_id", "lang", "text").repartition("doc_id")
    docs = written(docs.withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)), "words")
    true = docs.select("doc_id", "lang", "words").filter("size(words) > 0")
    counts = G.word_counts(docs) | G.free_strings(docs)
    found = G.segmented(true.select("doc_id", F.array_join("words", "").alias("text")), counts, pattern=r"\S+")
    return G.cut_quality(found, true, "lang")


# streams --------------------------------------------------------------------------------------------------------------
_GAP = 2 * 86_400


@query(f"""WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events), z AS (SELECT max(ts) - INTERVAL 1 HOUR AS stop FROM events)
SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS last_us, CAST(epoch_us(ts) + {_GAP}000000 AS BIGINT) AS due_us FROM e, z WHERE (following IS NULL OR following - ts >= INTERVAL {_GAP} SECOND) AND ts + INTERVAL {_GAP} SECOND < stop""")
def t5_silence_stream(spark, d):
    """Users silent for two days, told by timers of a stream over the events in four files by time, in two runs."""
    e = D.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, target, checkpoint = (fresh(spark, f"silence-{x}") for x in ("source", "target", "checkpoint"))
    low, high = e.agg(F.min("ts"), F.max("ts")).collect()[0]
    cuts = [low + (high - low) * k / 4 for k in range(5)]
    for k in range(4):
        part = e.filter((F.col("ts") >= F.lit(cuts[k])) & ((F.col("ts") < F.lit(cuts[k + 1])) if k < 3 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):
            silence.run(spark, source, "user_id long, ts timestamp", target, checkpoint, _GAP)
    out = spark.read.schema(silence.OUT).parquet(target)
    return out.select("user_id", F.unix_micros("last").alias("last_us"), F.unix_micros("due").alias("due_us"))
