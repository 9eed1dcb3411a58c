"""Queries of validation, verification, imports, answers and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate as A
from ..operators import upkeep as U
from ..sources import adapters as D
from .registry import EV, NEW, OLD, OR, _versions, case, query
from .registry_search import ENT, entries

CARDS = "v0 AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 17 = 0 THEN '2024/01/02' WHEN doc_id % 19 = 0 THEN NULL ELSE '2024-01-02' END AS date, CAST(1 + doc_id % 5 // 4 AS INT) AS schema_version, [CASE WHEN doc_id % 7 = 0 THEN 'ftp://x' ELSE 'https://x' END, ''] AS links, list_transform(range(0, CAST(doc_id % 13 AS BIGINT)), lambda i: CASE WHEN i = 3 THEN 'else/' || i ELSE 'Journals/2024/' || i || '.md' END) AS related FROM documents)"


def _cards(spark, d):
    """Documents as entries with heads, some of them at fault."""
    i = F.col("doc_id")
    related = F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(i % 13 - 1, F.lit(0))), lambda k: F.when(k == 3, F.concat(F.lit("else/"), k.cast("string"))).otherwise(F.concat(F.lit("Journals/2024/"), k.cast("string"), F.lit(".md")))))
    return D.table(spark, d, "documents").select(
        "doc_id", F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("Title "), i.cast("string"))).alias("title"),
        F.when(i % 17 == 0, "2024/01/02").when(i % 19 == 0, None).otherwise("2024-01-02").alias("date"), (1 + F.floor(i % 5 / 4)).cast("int").alias("schema_version"),
        F.array(F.when(i % 7 == 0, "ftp://x").otherwise("https://x"), F.lit("")).alias("links"), related.alias("related"),
    )


ISSUES = f"""{CARDS}, i0 AS (SELECT doc_id, unnest(list_filter([
CASE WHEN title = '' THEN {{'level': 'error', 'field': 'title', 'n': 1}} END, CASE WHEN coalesce(date, '') = '' THEN {{'level': 'error', 'field': 'date', 'n': 1}} END,
CASE WHEN date <> '' AND NOT regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}}:\\d{{2}})?$') THEN {{'level': 'warning', 'field': 'date', 'n': 1}} END,
CASE WHEN schema_version <> 1 THEN {{'level': 'warning', 'field': 'schema_version', 'n': 1}} END, CASE WHEN links[1] = 'ftp://x' THEN {{'level': 'warning', 'field': 'links', 'n': 1}} END,
CASE WHEN len(related) > 10 THEN {{'level': 'error', 'field': 'related_count', 'n': 1}} END, CASE WHEN len(related) > 3 THEN {{'level': 'error', 'field': 'related_entries', 'n': 1}} END], lambda x: x IS NOT NULL)) AS i FROM v0),
i1 AS (SELECT doc_id, i.level AS level, i.field AS field, CAST(i.n AS BIGINT) AS n FROM i0)"""


@query(f"WITH {ISSUES} SELECT * FROM i1")
def q1_entry_validation(spark, d):
    return U.validate(_cards(spark, d))


@query(f"WITH {ISSUES} SELECT level AS severity, count(*) AS n, count(DISTINCT doc_id) AS n_entries FROM i1 GROUP BY 1")
def a26_counts_by_severity(spark, d):
    return U.validate(_cards(spark, d)).groupBy(F.col("level").alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_entries"))


@query(f"WITH {CARDS} SELECT schema_version, count(*) AS n, schema_version <> 1 AS needs_migration FROM v0 GROUP BY 1")
def a27_schema_versions(spark, d):
    return _cards(spark, d).groupBy("schema_version").agg(F.count(F.lit(1)).alias("n")).withColumn("needs_migration", F.col("schema_version") != 1)


BROKEN = """l0 AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)', 1)) AS target FROM pages),
l1 AS (SELECT * FROM l0 WHERE target NOT IN (SELECT regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1) FROM pages WHERE url IS NOT NULL))"""


@query(f"WITH {BROKEN} SELECT page_id, target FROM l1")
def q6_j15_broken_links(spark, d):
    return U.broken_links(D.table(spark, d, "pages"), "page_id", "html", "url")


@query(f"SELECT level, key FROM (SELECT DISTINCT 'year' AS level, strftime(date, '%Y') AS key FROM {OR} UNION SELECT 'month', strftime(date, '%Y-%m') FROM {OR}) WHERE NOT (level = 'month' AND key NOT LIKE '%-03') AND NOT (level = 'year' AND key IN ('1995', '1996'))")
def q11_missing_indexes(spark, d):
    o = D.order_entries(spark, d)
    months = o.select(F.lit("month").alias("level"), F.date_format("date", "yyyy-MM").alias("key")).distinct().filter(~F.col("key").endswith("-03"))
    return U.missing_indexes(o, months.unionByName(spark.createDataFrame([("year", "1995"), ("year", "1996")], "level string, key string")))


_FILES = ["a_2024-01-02_001.md", "a_2024-01-02_001_20240103_101010_123456.md", "a_2024-01-02_002_20240103_101010_123456_2.md", "b_2024-01-02_1_x.md"]


@case("SELECT unnest(['a_2024-01-02_001_20240103_101010_123456.md', 'a_2024-01-02_002_20240103_101010_123456_2.md']) AS name, unnest(['a_2024-01-02_001.md', 'a_2024-01-02_002.md']) AS canonical, unnest([true, false]) AS repairable, unnest(['low', 'medium']) AS risk")
def q12_loose_copies(spark, d):
    return U.loose_copies(spark.createDataFrame([(x,) for x in _FILES], "name string"))


TOPICS = "t9 AS (SELECT topic, doc_id FROM " + EV + " WHERE topic = 'purchase' UNION ALL SELECT 'gone', doc_id + 100000000 FROM " + EV + " WHERE topic = 'error')"


@query(f"WITH {TOPICS} SELECT topic, doc_id FROM t9 WHERE doc_id NOT IN (SELECT doc_id FROM {EV})")
def j14_orphan_topic_links(spark, d):
    e = D.event_entries(spark, d)
    links = e.filter("topic = 'purchase'").select("topic", "doc_id").unionByName(e.filter("topic = 'error'").select(F.lit("gone").alias("topic"), (F.col("doc_id") + 100_000_000).alias("doc_id")))
    return links.join(e.select("doc_id"), "doc_id", "left_anti").select("topic", "doc_id")


@query(f"WITH {CARDS}, r AS (SELECT doc_id, unnest(related) AS target FROM v0) SELECT doc_id, target FROM r WHERE target NOT IN (SELECT 'Journals/2024/' || n_nationkey || '.md' FROM nation WHERE n_nationkey < 8)")
def j16_orphan_related_entries(spark, d):
    there = D.table(spark, d, "nation").filter("n_nationkey < 8").select(F.concat(F.lit("Journals/2024/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("target"))
    return _cards(spark, d).select("doc_id", F.explode("related").alias("target")).join(there, "target", "left_anti").select("doc_id", "target")


@query(f"SELECT doc_id FROM {OR} WHERE tag = 'BUILDING' AND doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j8_facet_and_supporting_entries(spark, d):
    support = D.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"))
    return D.order_entries(spark, d).filter("tag = 'BUILDING'").join(support, "doc_id", "left_semi").select("doc_id")


VERIFY = f"""{ISSUES}, {BROKEN}, {TOPICS}, k AS (SELECT 'frontmatter_valid' AS name, 'warning' AS worse, (SELECT count(*) FROM v0) AS count, (SELECT count(*) FROM i1 WHERE level = 'warning') AS n_issues
UNION ALL SELECT 'required_fields', 'warning', (SELECT count(*) FROM v0), (SELECT count(*) FROM i1 WHERE field = 'title' OR field = 'date' AND level = 'error')
UNION ALL SELECT 'fts_consistency', 'warning', (SELECT count(*) FROM {NEW}), (SELECT count(*) FROM {NEW} a FULL JOIN {OLD} b USING (doc_id) WHERE a.hash IS NULL OR b.hash IS NULL)
UNION ALL SELECT 'attachment_refs', 'warning', (SELECT count(*) FROM l0), (SELECT count(*) FROM l1)
UNION ALL SELECT 'topic_consistency', 'warning', (SELECT count(*) FROM t9), (SELECT count(*) FROM t9 WHERE doc_id NOT IN (SELECT doc_id FROM {EV}))
UNION ALL SELECT 'related_entries', 'error', (SELECT count(*) FROM v0), (SELECT count(*) FROM i1 WHERE field = 'related_entries'))"""


@query(f"WITH {VERIFY} SELECT name, CASE WHEN n_issues > 0 THEN worse ELSE 'ok' END AS status, count, n_issues FROM k")
def q2_verify(spark, d):
    cards, pages, e = _cards(spark, d), D.table(spark, d, "pages"), D.event_entries(spark, d)
    i, (old, new) = U.validate(cards), _versions(spark, d)
    apart = old.select("doc_id").join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new.select("doc_id").join(old.select("doc_id"), "doc_id", "left_anti"))
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)'), 1))))
    topics = e.filter("topic in ('purchase', 'error')").select("doc_id")
    return U.together([
        U.check("frontmatter_valid", i.filter("level = 'warning'"), cards), U.check("required_fields", i.filter("field = 'title' or field = 'date' and level = 'error'"), cards),
        U.check("fts_consistency", apart, new), U.check("attachment_refs", q6_j15_broken_links(spark, d), links),
        U.check("topic_consistency", j14_orphan_topic_links(spark, d), topics), U.check("related_entries", i.filter("field = 'related_entries'"), cards, "error"),
    ])


@query(f"""WITH {VERIFY}, m AS (SELECT 'index_freshness' AS name, (SELECT n_issues FROM k WHERE name = 'fts_consistency') AS n UNION ALL SELECT 'entity_audit', (SELECT count(*) FROM (SELECT lower(p_name) FROM part GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'orphan_related_entries', (SELECT count(*) FROM (SELECT unnest(related) AS target FROM v0) WHERE target NOT IN (SELECT 'Journals/2024/' || n_nationkey || '.md' FROM nation WHERE n_nationkey < 8))
UNION ALL SELECT 'search_eval_smoke', (SELECT count(*) FROM labels WHERE quality = 0) UNION ALL SELECT 'backup_verification', (SELECT count(*) FROM {NEW} a ANTI JOIN {OLD} b ON a.doc_id = b.doc_id AND a.hash = b.hash)
UNION ALL SELECT 'candidate_edges_count', (SELECT count(*) FROM (SELECT DISTINCT a.event_type, b.event_type FROM events a JOIN events b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_type < b.event_type)))
SELECT name, CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 'pass' WHEN name IN ('index_freshness', 'backup_verification') THEN 'fail' ELSE 'warn' END AS status FROM m""")
def q4_maintenance_checks(spark, d):
    from ..operators import graph as G

    old, new = _versions(spark, d)
    apart = old.select("doc_id").join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new.select("doc_id").join(old.select("doc_id"), "doc_id", "left_anti"))
    frames = {
        "index_freshness": apart, "entity_audit": G.duplicate_names(D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))),
        "orphan_related_entries": j16_orphan_related_entries(spark, d), "search_eval_smoke": D.table(spark, d, "labels").filter("quality = 0"),
        "backup_verification": new.join(old, ["doc_id", "hash"], "left_anti"), "candidate_edges_count": G.cooccurrence(D.event_entries(spark, d), ["user_id", "date"], "topic"),
    }
    rows = U.together([f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, f in frames.items()])
    return rows.withColumn("status", F.when(F.col("n") == 0, "pass").when(F.col("name").isin("index_freshness", "backup_verification"), "fail").otherwise("warn"))


PLAN = "g0 AS (SELECT doc_id AS record_id, text AS content, CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE sha256(text) END AS content_hash, 'Journals/' || (doc_id - doc_id % 29 // 28) || '.md' AS target FROM documents WHERE text IS NOT NULL)"


def _plan(spark, d):
    i = F.col("doc_id")
    return D.table(spark, d, "documents").filter("text is not null").select(i.alias("record_id"), F.col("text").alias("content"), F.when(i % 23 == 0, "x").otherwise(F.sha2("text", 256)).alias("content_hash"), F.concat(F.lit("Journals/"), (i - F.floor(i % 29 / 28)).cast("string"), F.lit(".md")).alias("target"))


@query(f"WITH {PLAN} SELECT record_id, 'hash_mismatch' AS problem FROM g0 WHERE sha256(content) <> content_hash UNION ALL SELECT record_id, 'target_not_unique' FROM g0 QUALIFY count(*) OVER (PARTITION BY target) > 1")
def q7_plan_problems(spark, d):
    return U.plan_problems(_plan(spark, d))


@query(f"""WITH {PLAN} SELECT record_id, CASE WHEN record_id % 5 = 0 THEN 'already_imported' WHEN record_id % 7 = 0 THEN 'source_drift' WHEN record_id % 11 = 0 AND record_id % 3 <> 0 THEN 'target_conflict' ELSE 'ready' END AS outcome FROM g0""")
def q16_import_checks(spark, d):
    p = _plan(spark, d).withColumns({"content_hash": F.sha2("content", 256), "key": F.concat(F.lit("k"), F.col("record_id").cast("string")), "target": F.concat(F.lit("t"), F.col("record_id").cast("string")), "source_hash": F.md5("content")}).drop("content")
    held = p.filter("record_id % 11 = 0").select("target", F.when(F.col("record_id") % 3 == 0, F.col("content_hash")).otherwise("other").alias("hash"))
    now = p.select("record_id", F.when(F.col("record_id") % 7 == 0, "changed").otherwise(F.col("source_hash")).alias("hash"))
    return U.pre_checks(p, p.filter("record_id % 5 = 0").select("key"), held, now)


@query("SELECT o_custkey AS job_id, count(*) AS n, bool_and(o_orderkey % 7 <> 3 AND o_orderkey % 11 <> 5) AS may_roll_back FROM orders GROUP BY 1")
def q16_rollback(spark, d):
    k = F.col("o_orderkey")
    rows = D.table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), k.alias("target"), F.md5("o_orderstatus").alias("hash"))
    now = rows.filter("target % 11 <> 5").select("target", F.when(F.col("target") % 7 == 3, "touched").otherwise(F.col("hash")).alias("hash"))
    return U.rollback(rows, now)


@query("SELECT n_nationkey AS id, n_nationkey % 4 = 0 OR n_nationkey % 5 = 1 OR n_nationkey % 3 = 2 AS would_rebuild, concat_ws(',', CASE WHEN n_nationkey % 4 = 0 THEN 'missing' END, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 5 = 1 THEN 'version_mismatch' END, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 3 = 2 THEN 'source_changed' END) AS reasons FROM nation")
def q15_cache_state(spark, d):
    k = F.col("n_nationkey")
    cache = D.table(spark, d, "nation").select(k.alias("id"), (k % 4 != 0).alias("present"), F.when(k % 5 == 1, 2).otherwise(3).alias("version"), F.when(k % 3 == 2, "old").otherwise("now").alias("hash"))
    return U.cache_state(cache, 3, F.lit("now"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 7 = 0 THEN 'degraded' WHEN event_id % 3 > 0 AND event_id % 5 > 2 THEN 'hybrid' WHEN event_id % 5 > 2 THEN 'semantic_only' WHEN event_id % 3 > 0 THEN 'fts_only' WHEN event_id % 2 = 0 THEN 'hybrid' ELSE 'fts_only' END AS signal FROM events")
def r29_signal_rules(spark, d):
    i = F.col("event_id")
    return D.table(spark, d, "events").select("event_id", U.pipeline_signal(i % 3, F.greatest(i % 5 - 2, F.lit(0)), i % 2 == 0, i % 7 == 0).alias("signal"))


@query("""WITH r AS (SELECT o_orderkey AS query_id, o_orderkey % 4 AS n, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 ELSE o_orderkey % 4 + o_orderkey % 2 END AS total, o_orderkey % 5 = 0 AS more, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 7 // 6 ELSE 0 END AS conf FROM orders),
k AS (SELECT query_id, CASE WHEN n = 0 AND more THEN 'low_confidence_with_potential_under_recall' WHEN n = 0 AND total = 0 THEN 'no_matches_found' WHEN conf = 0 AND total <= n AND NOT more THEN 'all_items_low_confidence_full_recall' WHEN conf > 0 THEN 'confident_results_present' ELSE 'low_confidence_with_potential_under_recall' END AS outcome_reason FROM r)
SELECT query_id, CASE outcome_reason WHEN 'no_matches_found' THEN 'zero_results' WHEN 'confident_results_present' THEN 'ok' ELSE 'weak_results' END AS retrieval_outcome, outcome_reason FROM k""")
def r24_retrieval_outcome(spark, d):
    k = F.col("o_orderkey")
    rows = D.table(spark, d, "orders").select(k.alias("query_id"), (k % 4).alias("n_items"), F.when(k % 3 == 0, k % 4).otherwise(k % 4 + k % 2).alias("total"), (k % 5 == 0).alias("has_more"), F.when(k % 4 > 0, F.floor(k % 7 / 6)).otherwise(0).alias("n_confident"))
    return U.outcome(rows)


@query(f"""WITH e AS (SELECT * FROM {EV}), c AS (SELECT 'journal_count' AS predicate, count(*) AS value, 0::BIGINT AS n_unknown, 'exact' AS exactness FROM e UNION ALL SELECT 'entry_time_after', count(*) FILTER (tm >= 720), count(*) FILTER (tm IS NULL), CASE WHEN count(*) FILTER (tm IS NULL) > 0 THEN 'partial' ELSE 'exact' END FROM e
UNION ALL SELECT 'term_presence', count(*) FILTER (contains(props, '7')), 0, 'approximate' FROM e UNION ALL SELECT 'entity_presence', count(*) FILTER (user_id IN (1, 2)), 0, 'approximate' FROM e UNION ALL SELECT 'field_equals', count(*) FILTER (topic = 'click'), 0, 'exact' FROM e)
SELECT predicate, value, n_unknown, exactness, CASE exactness WHEN 'approximate' THEN 'medium' ELSE 'high' END AS confidence, 'measurable_' || exactness AS claim_type FROM c""")
def a5_p9_claims(spark, d):
    e = D.event_entries(spark, d)
    asks = {"journal_count": F.lit(True), "entry_time_after": F.col("time_minutes") >= 720, "term_presence": F.contains("props", F.lit("7")), "entity_presence": F.col("user_id").isin(1, 2), "field_equals": F.lower("topic") == "click"}
    rows = []
    for name, p in asks.items():
        r = A.roles(e, p).agg(F.count_if(F.col("role") == "matched").alias("value"), F.count_if(F.col("role") == "unknown").alias("n_unknown"))
        exact, sure, kind = U.claim(name, F.col("n_unknown"))
        rows.append(r.select(F.lit(name).alias("predicate"), "value", "n_unknown", exact.alias("exactness"), sure.alias("confidence"), kind.alias("claim_type")))
    return U.together(rows)


@query(f"SELECT strftime(date, '%Y-%m-%d') AS bucket, count(*) AS n_matched, array_to_string(list_sort(list(doc_id))[1:20], ',') AS paths FROM {EV} WHERE topic = 'error' GROUP BY 1")
def a1_a6_bucket_evidence(spark, d):
    return U.evidence(A.roles(D.event_entries(spark, d), F.col("topic") == "error"), T.bucket(F.col("date"), "day"))


@query("""WITH r AS (SELECT source || ' ' || lang AS query_id, doc_id, CAST(n_chars AS DOUBLE) AS s, doc_id % 2 = 0 AS g FROM documents), c AS (SELECT unnest(['graph', 'plain']) AS combo),
t AS (SELECT combo, query_id, doc_id, row_number() OVER (PARTITION BY combo, query_id ORDER BY s * CASE WHEN combo = 'graph' AND g THEN 2 ELSE 1 END DESC, doc_id) AS rank FROM r, c QUALIFY rank <= 5),
q AS (SELECT source || ' ' || lang AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), n AS (SELECT query_id, count(*) AS size FROM q GROUP BY 1),
h AS (SELECT combo, query_id, count(q.doc_id) AS hits, min(rank) FILTER (q.doc_id IS NOT NULL) AS f FROM t LEFT JOIN q USING (query_id, doc_id) GROUP BY 1, 2)
SELECT combo, round(avg(hits / 5), 4) AS prec, round(avg(coalesce(hits / size, 0)), 4) AS recall, round(avg(coalesce(1 / f, 0)), 4) AS mrr FROM h LEFT JOIN n USING (query_id) GROUP BY combo""")
def a21_ablation(spark, d):
    from pyspark.sql import Window

    docs = D.table(spark, d, "documents").select(F.concat_ws(" ", "source", "lang").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("s"))
    combos = docs.select("*", F.explode(F.array(F.lit("graph"), F.lit("plain"))).alias("combo"))
    boost = F.when((F.col("combo") == "graph") & (F.col("doc_id") % 2 == 0), 2).otherwise(1)
    ranked = combos.withColumn("rank", F.row_number().over(Window.partitionBy("combo", "query_id").orderBy(F.desc(F.col("s") * boost), "doc_id")))
    good = docs.join(D.table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("query_id", "doc_id")
    return U.ablation(ranked.filter("rank <= 5"), good)


@query("""WITH q AS (SELECT source || ' ' || lang AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), r AS (SELECT source || ' ' || lang AS query_id, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE lang <> 'fr' QUALIFY k <= 5),
h AS (SELECT query_id, count(*) AS hits, min(k) AS f FROM r SEMI JOIN q USING (query_id, doc_id) GROUP BY 1), n AS (SELECT query_id, count(*) AS size FROM q GROUP BY 1), a AS (SELECT DISTINCT source || ' ' || lang AS query_id FROM documents)
SELECT count(size) AS n_queries, count(*) - count(size) AS n_skipped, round(avg(CASE WHEN size IS NOT NULL THEN coalesce(1 / f, 0) END), 4) AS mean_mrr, round(avg(CASE WHEN size IS NOT NULL THEN coalesce(hits / size, 0) END), 4) AS mean_recall FROM a LEFT JOIN n USING (query_id) LEFT JOIN h USING (query_id)""")
def a32_mean_metrics(spark, d):
    from ..operators import evaluate as E

    docs = D.table(spark, d, "documents").select(F.concat_ws(" ", "source", "lang").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    good = docs.join(D.table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("query_id", "doc_id")
    return E.means(docs.select("query_id").distinct(), docs.filter("lang <> 'fr'").select("query_id", "doc_id", "score"), good)


LOG = "g9 AS (SELECT event_id AS id, ts, 'q' || (event_id % 50) AS query, value AS latency_ms, event_id % 6 AS result_count, CASE WHEN event_type = 'error' THEN 'degraded' ELSE 'fts_only' END AS signal, CASE WHEN event_id % 9 = 0 THEN ['slow', 'stale'] ELSE [] END AS warnings FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')"


@query(f"""WITH {LOG} SELECT 'mean' AS kind, '' AS key, count(*) AS n, round(avg(latency_ms), 4) AS value FROM g9 UNION ALL SELECT 'p95', '', count(*), quantile_disc(latency_ms, 0.95) FROM g9 UNION ALL SELECT 'zero_result_queries', '', count(DISTINCT query) FILTER (result_count = 0), NULL FROM g9
UNION ALL SELECT 'signal', signal, count(*), NULL FROM g9 GROUP BY signal UNION ALL SELECT 'warning', w, count(*), NULL FROM (SELECT unnest(warnings) AS w FROM g9) GROUP BY w
UNION ALL (SELECT 'outlier', CAST(id AS VARCHAR), 1, latency_ms FROM g9 WHERE latency_ms > 200 ORDER BY latency_ms DESC, id LIMIT 20) UNION ALL (SELECT 'degraded', CAST(id AS VARCHAR), 1, NULL FROM g9 WHERE signal = 'degraded' ORDER BY id LIMIT 10)""")
def a18_t9_diagnosis(spark, d):
    i = F.col("event_id")
    log = D.table(spark, d, "events").select(i.alias("id"), "ts", F.concat(F.lit("q"), (i % 50).cast("string")).alias("query"), F.col("value").alias("latency_ms"), (i % 6).alias("result_count"), F.when(F.col("event_type") == "error", "degraded").otherwise("fts_only").alias("signal"), F.when(i % 9 == 0, F.array(F.lit("slow"), F.lit("stale"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return U.diagnosis(log, F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query(f"WITH a AS (SELECT source AS k, count(*) AS n, count(*) FILTER (contains(lower(body), 'license')) AS hits FROM {ENT}, (SELECT doc_id AS i, source FROM documents) s WHERE i = doc_id GROUP BY 1) SELECT 'keyword' AS layer, 'queries' AS metric, CAST(count(*) AS DOUBLE) AS value FROM a UNION ALL SELECT 'keyword', 'hit_rate', round(avg((hits > 0)::INT), 4) FROM a UNION ALL SELECT 'expansion', 'applied', CAST(count(*) FILTER (n > 10) AS DOUBLE) FROM a UNION ALL SELECT 'expansion', 'rate', round(count(*) FILTER (n > 10) / count(*), 4) FROM a")
def a24_calibration_layers(spark, d):
    a = entries(spark, d).groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("body").contains("license")).alias("hits"))
    one = a.agg(F.count(F.lit(1)).cast("double").alias("queries"), F.round(F.avg((F.col("hits") > 0).cast("int")), 4).alias("hit_rate"), F.count_if(F.col("n") > 10).cast("double").alias("applied"))
    one = one.withColumn("rate", F.round(F.col("applied") / F.col("queries"), 4))
    each = F.array(*(F.struct(F.lit(layer).alias("layer"), F.lit(m).alias("metric"), F.col(m).alias("value")) for layer, m in (("keyword", "queries"), ("keyword", "hit_rate"), ("expansion", "applied"), ("expansion", "rate"))))
    return one.select(F.explode(each).alias("r")).select("r.layer", "r.metric", "r.value")


_FLAG = {"blank_text": ("high", "text IS NULL OR trim(text) = ''"), "byte_order_mark": ("low", "starts_with(text, chr(65279))"), "mojibake": ("medium", "regexp_matches(text, 'Ã©|Ã¨|â€|ï¿½')"), "local_path": ("low", r"regexp_matches(text, '(/home/|/Users/|[A-Z]:\\)')"),
         "key_like": ("high", "regexp_matches(text, '(AKIA[A-Z0-9]{14}|ghp_[A-Za-z0-9]{20}|sk-[A-Za-z0-9]{20})')"), "length_mismatch": ("medium", "n_chars <> length(text)"), "no_source": ("medium", "source IS NULL OR source = ''"), "no_language": ("medium", "lang IS NULL OR lang = ''")}
_DOCTOR = " UNION ALL ".join([*(f"SELECT '{k}' AS detector, '{v}' AS severity, count(*) FILTER ({c}) AS n_found, count(*) AS n_checked FROM documents" for k, (v, c) in _FLAG.items()),
    "SELECT 'repeated_text', 'low', count(*) - count(DISTINCT text) - count(*) FILTER (text IS NULL), count(*) FROM documents",
    "SELECT 'label_without_document', 'high', count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)), count(*) FROM labels",
    "SELECT 'two_labels', 'high', count(*) - count(DISTINCT doc_id), count(*) FROM labels",
    "SELECT 'page_without_url', 'high', count(*) FILTER (url IS NULL), count(*) FROM pages", "SELECT 'repeated_url', 'low', count(url) - count(DISTINCT url), count(*) FROM pages",
    "SELECT 'line_without_order', 'high', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)), count(*) FROM lineitem",
    "SELECT 'order_without_customer', 'high', count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)), count(*) FROM orders", "SELECT 'order_without_line', 'medium', count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)), count(*) FROM orders"])


@query(f"SELECT *, CASE WHEN n_found = 0 THEN 'ok' WHEN severity = 'high' THEN 'blocked' ELSE 'review' END AS verdict FROM ({_DOCTOR})")
def q3_data_doctor(spark, d):
    """One report of sixteen detectors over the tables: what was looked at, what was found, and how bad it is."""
    t = F.col("text")
    flags = {
        "blank_text": ("high", t.isNull() | (F.trim("text") == "")), "byte_order_mark": ("low", t.startswith("\ufeff")), "mojibake": ("medium", t.rlike("Ã©|Ã¨|â€|ï¿½")), "local_path": ("low", t.rlike(r"(/home/|/Users/|[A-Z]:\\)")),
        "key_like": ("high", t.rlike("(AKIA[A-Z0-9]{14}|ghp_[A-Za-z0-9]{20}|sk-[A-Za-z0-9]{20})")), "length_mismatch": ("medium", F.col("n_chars") != F.length("text")), "no_source": ("medium", F.col("source").isNull() | (F.col("source") == "")), "no_language": ("medium", F.col("lang").isNull() | (F.col("lang") == "")),
    }
    return U.doctor(
        [
            (D.table(spark, d, "documents"), flags, {"repeated_text": ("low", ["text"])}, {}),
            (D.table(spark, d, "labels"), {}, {"two_labels": ("high", ["doc_id"])}, {"label_without_document": ("high", "doc_id", D.table(spark, d, "documents").select("doc_id"))}),
            (D.table(spark, d, "pages"), {"page_without_url": ("high", F.col("url").isNull())}, {"repeated_url": ("low", ["url"])}, {}),
            (D.table(spark, d, "lineitem"), {}, {}, {"line_without_order": ("high", "l_orderkey", D.table(spark, d, "orders").select("o_orderkey"))}),
            (D.table(spark, d, "orders"), {}, {}, {"order_without_customer": ("high", "o_custkey", D.table(spark, d, "customer").select("c_custkey")), "order_without_line": ("medium", "o_orderkey", D.table(spark, d, "lineitem").select("l_orderkey"))}),
        ]
    )


_SWITCH = {"language": "lang = 'en'", "license": "contains(text, 'License')", "short": "n_chars < 2000"}
_ON = " || ".join(f"CASE WHEN {k} THEN '+{k}' ELSE '-{k}' END" for k in _SWITCH)
_BOOST = " * ".join(f"CASE WHEN {k} AND s_{k} THEN 2 ELSE 1 END" for k in _SWITCH)


@query(f"""WITH r AS (SELECT source AS query_id, doc_id, CAST(n_chars AS DOUBLE) AS s, {', '.join(f'coalesce({c}, false) AS s_{k}' for k, c in _SWITCH.items())} FROM documents WHERE source IS NOT NULL),
c AS (SELECT {', '.join(_SWITCH)}, {_ON} AS combo FROM {' CROSS JOIN '.join(f'(SELECT unnest([true, false]) AS {k}) x_{k}' for k in _SWITCH)}),
t AS (SELECT combo, query_id, doc_id, row_number() OVER (PARTITION BY combo, query_id ORDER BY s * {_BOOST} DESC, doc_id) AS rank FROM r, c QUALIFY rank <= 5),
q AS (SELECT source AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), n AS (SELECT query_id, count(*) AS size FROM q GROUP BY 1),
h AS (SELECT combo, query_id, count(q.doc_id) AS hits, min(rank) FILTER (q.doc_id IS NOT NULL) AS f FROM t LEFT JOIN q USING (query_id, doc_id) GROUP BY 1, 2)
SELECT combo, round(avg(hits / 5), 6) AS prec, round(avg(coalesce(hits / size, 0)), 6) AS recall, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM h LEFT JOIN n USING (query_id) GROUP BY combo""")
def a21_ablation_of_three_signals(spark, d):
    """All eight combinations of three signals of the texts, each on or off: what they do to the first five of a source."""
    from pyspark.sql import Window

    signals = {"language": F.col("lang") == "en", "license": F.contains("text", F.lit("License")), "short": F.col("n_chars") < 2000}
    docs = D.table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("s"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in signals.items()))
    combos = U.switched(docs, list(signals), "s")
    place = F.row_number().over(Window.partitionBy("combo", "query_id").orderBy(F.desc("boosted"), "doc_id"))
    good = docs.join(D.table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("query_id", "doc_id")
    return U.ablation(combos.withColumn("rank", place).filter("rank <= 5"), good, digits=6)


_HEAD = r"""u0 AS (SELECT page_id AS doc_id, coalesce(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS title, regexp_extract(html, '\d{4}[-/]\d{2}[-/]\d{2}') AS date, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links, url IS NOT NULL AND starts_with(url, 'https') AS secure, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: starts_with(x, '/')) AS related FROM pages),
u1 AS (SELECT doc_id, title, date, CASE WHEN secure THEN 1 ELSE 0 END AS schema_version, len(list_filter(links, lambda x: x <> '' AND NOT regexp_matches(x, '^https?://'))) AS n_links, len(related) AS n_related, len(list_filter(related, lambda x: NOT regexp_matches(x, '^Journals/.+\.md$'))) AS n_paths FROM u0),
u2 AS (SELECT doc_id, 'error' AS level, 'title' AS field, 1 AS n FROM u1 WHERE title = '' UNION ALL SELECT doc_id, 'error', 'date', 1 FROM u1 WHERE coalesce(date, '') = '' UNION ALL SELECT doc_id, 'warning', 'date', 1 FROM u1 WHERE date <> '' AND NOT regexp_matches(date, '^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$')
UNION ALL SELECT doc_id, 'warning', 'schema_version', 1 FROM u1 WHERE schema_version <> 1 UNION ALL SELECT doc_id, 'warning', 'links', n_links FROM u1 WHERE n_links > 0 UNION ALL SELECT doc_id, 'error', 'related_count', 1 FROM u1 WHERE n_related > 10 UNION ALL SELECT doc_id, 'error', 'related_entries', n_paths FROM u1 WHERE n_paths > 0)"""


def _page_heads(spark, d):
    """Pages as entries: their heading, the first date in them, their links, and those within the site as related entries."""
    html = F.col("html")
    links = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)
    return D.table(spark, d, "pages").select(
        F.col("page_id").alias("doc_id"), F.coalesce(F.regexp_extract(html, "<h1>([^<]*)</h1>", 1), F.lit("")).alias("title"), F.regexp_extract(html, r"\d{4}[-/]\d{2}[-/]\d{2}", 0).alias("date"),
        F.when(F.coalesce(F.startswith("url", F.lit("https")), F.lit(False)), 1).otherwise(0).alias("schema_version"), links.alias("links"), F.filter(links, lambda x: x.startswith("/")).alias("related"),
    )


@query(f"WITH {_HEAD} SELECT doc_id, level, field, CAST(n AS BIGINT) AS n FROM u2")
def q1_page_validation(spark, d):
    """Headings, dates, links and related paths of real pages by the rules of entries."""
    return U.validate(_page_heads(spark, d)).select("doc_id", "level", "field", F.col("n").cast("long").alias("n"))


@query(f"WITH {_HEAD} SELECT level AS severity, field, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_values FROM u2 GROUP BY 1, 2")
def a26_page_faults_by_severity(spark, d):
    return U.validate(_page_heads(spark, d)).groupBy(F.col("level").alias("severity"), "field").agg(F.count(F.lit(1)).alias("n"), F.sum("n").cast("long").alias("n_values"))


@query(f"WITH {_HEAD} SELECT schema_version, count(*) AS n, schema_version <> 1 AS needs_migration FROM u1 GROUP BY 1")
def a27_versions_of_pages(spark, d):
    return _page_heads(spark, d).groupBy("schema_version").agg(F.count(F.lit(1)).alias("n")).withColumn("needs_migration", F.col("schema_version") != 1)


@query("""WITH q AS (SELECT source AS query_id, count(*) FILTER (n_chars > 8000) AS n, count(*) AS total, count(*) > 40 AS more, count(*) FILTER (quality = 1 AND n_chars > 8000) AS conf FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) WHERE source IS NOT NULL GROUP BY 1),
k AS (SELECT query_id, CASE WHEN n = 0 AND more THEN 'low_confidence_with_potential_under_recall' WHEN n = 0 AND total = 0 THEN 'no_matches_found' WHEN conf = 0 AND total <= n AND NOT more THEN 'all_items_low_confidence_full_recall' WHEN conf > 0 THEN 'confident_results_present' ELSE 'low_confidence_with_potential_under_recall' END AS outcome_reason FROM q)
SELECT query_id, CASE outcome_reason WHEN 'no_matches_found' THEN 'zero_results' WHEN 'confident_results_present' THEN 'ok' ELSE 'weak_results' END AS retrieval_outcome, outcome_reason FROM k""")
def r24_outcome_by_source(spark, d):
    """Each source as a query: its long documents are what was shown, those of good quality the confident ones, all of them what there is."""
    labels = D.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = D.table(spark, d, "documents").filter("source is not null").join(labels, "doc_id", "left")
    shown = F.col("n_chars") > 8000
    rows = docs.groupBy(F.col("source").alias("query_id")).agg(F.count_if(shown).alias("n_items"), F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) > 40).alias("has_more"), F.count_if(shown & (F.col("quality") == 1)).alias("n_confident"))
    return U.outcome(rows)
