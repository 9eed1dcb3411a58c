"""Queries that go through sources and sinks: what is written to the shared folder is read back. With their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as D
from ..sources import frontmatter as M
from ..sources import store as S
from .registry import EV, OR, case, query
from .registry_search import ENT, entries


@query("SELECT event_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def s9_k6_log(spark, d):
    """Two appends and lines that are no JSON; a week is read back."""
    path, e = S.fresh(spark, "log"), D.table(spark, d, "events").select("event_id", "event_type", "value", "ts")
    S.append_log(e.filter("event_id % 2 = 0"), path)
    S.append_log(e.filter("event_id % 2 = 1"), path)
    spark.createDataFrame([("{not json",), ('{"event_id": "x", "ts": 3}',)], "value string").write.mode("append").text(path)
    return S.read_log(spark, path, "event_id long, event_type string, value double, ts timestamp", "2024-01-05", "2024-01-12").drop("ts")


@query("SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN '' ELSE 'said \"so\", twice' || chr(10) || 'and again' END AS note FROM benchmark")
def k5_review_table(spark, d):
    path = S.fresh(spark, "review")
    note = F.when(F.col("item_id") % 3 == 0, None).when(F.col("item_id") % 3 == 1, "").otherwise('said "so", twice\nand again')
    S.export_review(D.table(spark, d, "benchmark").select("item_id", "text", note.alias("note")), path)
    return S.import_review(spark, path, "item_id long, text string, note string")


@query(f"SELECT doc_id, topic, body FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'edited' ELSE topic END AS topic, CASE WHEN doc_id % 20 = 0 THEN body || chr(10) || chr(10) || 'more' WHEN doc_id % 10 = 0 THEN 'new' ELSE body END AS body, date FROM {ENT}) WHERE year(date) = 2024 AND month(date) IN (2, 3)")
def k1_k2_s7_edited_entries(spark, d):
    """Entries are written by year and month, some are edited, and two months are read back (others aren't scanned)."""
    e = entries(spark, d).select("doc_id", "topic", "body", "date")
    edits = e.filter("doc_id % 10 = 0").select("doc_id", F.lit("edited").alias("field_topic"), F.when(F.col("doc_id") % 20 == 0, "more").otherwise("new").alias("body"), F.when(F.col("doc_id") % 20 == 0, "append").otherwise("replace").alias("mode"))
    path = S.fresh(spark, "entries")
    M.write_entries(S.edited(e, edits)[0].withColumns({"year": F.year("date"), "month": F.month("date")}), path)
    return spark.read.parquet(path).filter("year = 2024 and month in (2, 3)").select("doc_id", "topic", "body")


@query(f"SELECT doc_id, topic, md5(body) AS body_md5 FROM {ENT} WHERE doc_id % 10 = 0")
def k2_revisions(spark, d):
    e = entries(spark, d).select("doc_id", "topic", "body")
    return S.edited(e, e.filter("doc_id % 10 = 0").select("doc_id", F.lit("x").alias("field_topic"), F.lit("y").alias("body"), F.lit("replace").alias("mode")))[1].select("doc_id", "topic", F.md5("body").alias("body_md5"))


@query("SELECT CAST(n_nationkey AS VARCHAR) || '.md' AS name, 'Title ' || n_name AS title, '2024-01-' || lpad(CAST(1 + n_nationkey AS VARCHAR), 2, '0') AS date, 'a|b: c' AS tags, 'Heading' || chr(10) || '--- not an end' AS body FROM nation")
def s1_s2_entry_files(spark, d):
    """One Markdown file with a head for each nation, written and read back."""
    n, path = D.table(spark, d, "nation"), S.fresh(spark, "journal")
    text = F.concat(F.lit("---\ntitle: 'Title "), "n_name", F.lit("'\ndate: 2024-01-"), F.lpad((1 + F.col("n_nationkey")).cast("string"), 2, "0"), F.lit("\ntags: [a, 'b: c']\nsource: 'x --- y'\n---\n\nHeading\n--- not an end\n"))
    n.select(F.col("n_nationkey").alias("k"), text.alias("value")).repartition("k").write.partitionBy("k").option("lineSep", "\x00").text(path)
    e = M.read_entries(spark, f"{path}/k=*/*.txt")
    name = F.concat(F.regexp_extract("rel_path", r"k=(\d+)/", 1), F.lit(".md"))
    return e.select(name.alias("name"), "title", "date", F.array_join("tags", "|").alias("tags"), F.regexp_replace("body", r"[\s\x00]+$", "").alias("body"))


@query("SELECT doc_id, text AS content, true AS intact FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 4")
def k7_backup_and_restore(spark, d):
    """A full backup, changes, an incremental one, and what the chain restores."""
    t = D.table(spark, d, "documents").filter("text is not null")
    name = F.col("doc_id").cast("string").alias("name")
    old = t.select(name, F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("text")).alias("content"))
    now = t.filter("doc_id % 5 <> 4").select(name, F.col("text").alias("content"))
    a, b = S.fresh(spark, "backup"), S.fresh(spark, "backup")
    S.backup(old, a)
    S.backup(now, b, a)
    return S.restore(spark, [a, b]).select(F.col("name").cast("long").alias("doc_id"), "content", "intact")


@query("SELECT 'plan' AS adapter_id, CAST(item_id AS VARCHAR) AS source_record_id, sha256(text) AS content_hash, 'T' || item_id AS title, '2024-05-01' AS date, 'x,y' AS tags, CAST(item_id % 3 AS INTEGER) AS n_attachments FROM benchmark")
def s11_import_source(spark, d):
    n, path = F.col("item_id").cast("string"), S.fresh(spark, "import")
    files = F.filter(F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.struct(F.concat(n, F.lit("-"), k.cast("string")).alias("attachment_id"), k.alias("size_bytes"))), lambda a: a["size_bytes"] <= F.col("item_id") % 3)
    journal = F.struct(F.concat(F.lit("T"), n).alias("title"), F.lit("2024-05-01").alias("date"), F.array(F.lit("x"), F.lit("y")).alias("tags"), F.col("text").alias("content"))
    one = D.table(spark, d, "benchmark").groupBy((F.col("item_id") % 4).alias("part")).agg(F.collect_list(F.struct(n.alias("source_record_id"), F.sha2("text", 256).alias("content_hash"), journal.alias("journal"), files.alias("attachments"))).alias("records"))
    one.select(F.lit("plan").alias("adapter_id"), F.lit("in").alias("input_label"), "records").repartition("records").write.option("maxRecordsPerFile", 1).json(path)
    return S.read_import(spark, path).withColumn("tags", F.array_join("tags", ","))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'second' ELSE 'first' END AS state, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS version FROM orders WHERE o_orderkey % 7 <> 0")
def t1_t2_k3_pending_writes(spark, d):
    """Two runs over a queue: inserts, then updates and deletes."""
    q, to, mark = S.fresh(spark, "queue"), S.fresh(spark, "index"), S.fresh(spark, "mark")
    schema = "doc_id long, state string, version int, deleted boolean"
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    o.select("doc_id", F.lit("first").alias("state"), F.lit(1).alias("version"), F.lit(False).alias("deleted")).write.parquet(q)
    S.consume_pending(spark, q, schema, to, mark)
    o.filter("doc_id % 4 = 0").select("doc_id", F.lit("second").alias("state"), F.lit(2).alias("version"), F.lit(False).alias("deleted")).write.mode("append").parquet(q)
    o.filter("doc_id % 7 = 0").select("doc_id", F.lit("gone").alias("state"), F.lit(3).alias("version"), F.lit(True).alias("deleted")).write.mode("append").parquet(q)
    return S.consume_pending(spark, q, schema, to, mark)


@query(f"SELECT doc_id, title, topic, array_to_string(tags, ',') AS tags FROM {ENT}")
def s3_metadata_cache(spark, d):
    """A metadata cache with arrays as JSON, written and decoded."""
    path = S.fresh(spark, "cache")
    entries(spark, d).select("doc_id", "title", "topic", F.to_json("tags").alias("tags")).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", "title", "topic", F.array_join(F.from_json("tags", "array<string>"), ",").alias("tags"))


@query(f"SELECT 'topic' AS kind, topic AS value, doc_id FROM {OR} WHERE topic = '1-URGENT' UNION ALL SELECT 'project', location, doc_id FROM {OR} WHERE location = 'NATION_3' UNION ALL SELECT 'tag', tag, doc_id FROM {OR} WHERE tag = 'BUILDING'")
def s5_link_index(spark, d):
    o = D.order_entries(spark, d)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("topic", "topic"), ("project", "location"), ("tag", "tag"))))
    links = o.select("doc_id", F.explode(kinds).alias("x")).select("x.kind", "x.value", "doc_id")
    return links.filter("(kind = 'topic' and value = '1-URGENT') or (kind = 'project' and value = 'NATION_3') or (kind = 'tag' and value = 'BUILDING')")


@query(f"SELECT 'batch' AS how, doc_id FROM {EV} WHERE doc_id IN (3, 5, 7, 1000000000) UNION ALL (SELECT 'recent', doc_id FROM {EV} ORDER BY date DESC, doc_id DESC LIMIT 10)")
def s13_entries_by_reference(spark, d):
    e = D.event_entries(spark, d)
    batch = e.filter(F.col("doc_id").isin(3, 5, 7, 1_000_000_000)).select(F.lit("batch").alias("how"), "doc_id")
    return batch.unionByName(e.orderBy(F.desc("date"), F.desc("doc_id")).limit(10).select(F.lit("recent").alias("how"), "doc_id"))


@query("SELECT page_id, name, CASE WHEN n > 1 THEN regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || '_' || n || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) ELSE name END AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM (SELECT page_id, 'file' || (page_id % 20) || CASE WHEN page_id % 3 = 0 THEN '.png' ELSE '' END AS name FROM pages))")
def s15_unique_file_names(spark, d):
    k = F.col("page_id")
    p = D.table(spark, d, "pages").select("page_id", F.concat(F.lit("file"), (k % 20).cast("string"), F.when(k % 3 == 0, ".png").otherwise("")).alias("name"))
    return S.unique_names(p, "name", "page_id")


RANGES = [("bytes=0-9", 0, 9), ("bytes=90-", 90, 99), ("bytes=-5", 95, 99), ("bytes=50-500", 50, 99), ("bytes=100-", None, None), ("bytes=9-3", None, None), ("items=1-2", None, None), ("bytes=-500", 0, 99)]


@case("SELECT * FROM (VALUES " + ", ".join(f"('{h}', {'NULL' if a is None else a}::BIGINT, {'NULL' if b is None else b}::BIGINT)" for h, a, b in RANGES) + ") t(header, first, last)")
def s14_byte_ranges(spark, d):
    r = spark.createDataFrame([(h,) for h, _, _ in RANGES], "header string").withColumn("r", S.byte_range(F.col("header"), F.lit(100)))
    return r.select("header", F.col("r.start").cast("long").alias("first"), F.col("r.end").cast("long").alias("last"))


@query(f"""WITH m AS (SELECT strftime(date, '%Y-%m') AS month, topic, count(*) AS n FROM {OR} GROUP BY 1, 2), k AS (SELECT 'month' AS level, month AS key, topic, n FROM m UNION ALL SELECT 'year', substr(month, 1, 4), topic, n FROM m UNION ALL SELECT 'root', 'all', topic, n FROM m), s AS (SELECT level, key, topic, sum(n) AS n FROM k GROUP BY 1, 2, 3)
SELECT level, key, '# ' || key || chr(10) || chr(10) || sum(n) || ' entries' || chr(10) || chr(10) || string_agg('- ' || topic || ': ' || n, chr(10) ORDER BY n DESC, topic) AS doc FROM s GROUP BY level, key""")
def k4_calendar_docs(spark, d):
    path = S.fresh(spark, "docs")
    S.calendar_docs(D.order_entries(spark, d)).write.partitionBy("level").parquet(path)
    return spark.read.parquet(path).select("level", "key", "doc")


_WEATHER = [(0, "clear"), (3, "overcast"), (45, "fog"), (61, "rain"), (71, "snow"), (95, "thunderstorm")]


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'clear' WHEN 1 THEN 'overcast' WHEN 2 THEN 'fog' WHEN 3 THEN 'rain' WHEN 4 THEN 'snow' WHEN 5 THEN 'thunderstorm' ELSE 'unknown' END AS weather FROM events")
def s12_weather_codes(spark, d):
    codes = spark.createDataFrame(_WEATHER, "code int, said string")
    given = F.try_element_at(F.create_map(*(F.lit(x) for k, (c, _) in enumerate(_WEATHER) for x in (k, c))), (F.col("event_id") % 7).cast("int"))
    e = D.table(spark, d, "events").select("event_id", F.coalesce(given, F.lit(-1)).alias("code"))
    return e.join(F.broadcast(codes), "code", "left").select("event_id", F.coalesce("said", F.lit("unknown")).alias("weather"))
