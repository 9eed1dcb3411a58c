"""Queries of typed trajectories, roll-ups with their signals, predicates over lists and metadata, fingerprints and ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..operators import entities as N
from ..sources import adapters as D
from .registry import EV, OR, query
from .registry_search import ENT, entries

NOTES = r"""n9 AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS date, 60 + o_orderkey % 20 AS w, o_orderkey % 9 AS h, ['Lyon', 'Oslo', 'New York'][1 + o_orderkey % 3] AS p, ['Atlas', 'The', 'Borealis'][1 + o_orderkey % 3] AS j, ['calm', ' ', 'glad'][1 + o_orderkey % 3] AS m,
['🎉 a warm day', '😢 sad and tired', 'nothing'][1 + o_orderkey % 3] AS f FROM orders),
n8 AS (SELECT *, 'Weight measured at ' || w || '.5 kg, 体重：' || (w + 1) || 'kg. Slept for about ' || h || ' hours; 睡了 ' || h || '.5 小时. We met in ' || p || ' and left. ' || j || ' project. ' || f AS body FROM n9)"""


def _notes(spark, d):
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % 3 + 1).cast("int"))
    o = D.table(spark, d, "orders").select(k.alias("doc_id"), F.to_date("o_orderdate").alias("date"), (60 + k % 20).alias("w"), (k % 9).alias("h"), pick("Lyon", "Oslo", "New York").alias("p"), pick("Atlas", "The", "Borealis").alias("j"), pick("calm", " ", "glad").alias("m"), pick("🎉 a warm day", "😢 sad and tired", "nothing").alias("f"))
    s = lambda c: F.col(c).cast("string")
    body = F.concat(F.lit("Weight measured at "), s("w"), F.lit(".5 kg, 体重："), (F.col("w") + 1).cast("string"), F.lit("kg. Slept for about "), s("h"), F.lit(" hours; 睡了 "), s("h"), F.lit(".5 小时. We met in "), s("p"), F.lit(" and left. "), s("j"), F.lit(" project. "), s("f"))
    return o.withColumn("body", body)


@query(f"WITH {NOTES} SELECT doc_id, CAST(date AS VARCHAR) AS day, unnest(CASE WHEN doc_id % 2 = 0 THEN [w::DOUBLE] ELSE [] END || [(w + 1)::DOUBLE, w + 0.5::DOUBLE]) AS value FROM n8 WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
def f21_weight_trajectory(spark, d):
    n = _notes(spark, d).filter(F.col("date").between("1996-01-01", "1996-06-30"))
    field = F.when(F.col("doc_id") % 2 == 0, F.col("w").cast("string")).otherwise("unknown")
    return n.select("doc_id", F.col("date").cast("string").alias("day"), F.explode(X.weights(field, F.col("body"))).alias("value"))


@query(f"WITH {NOTES} SELECT doc_id, unnest([h + 0.5::DOUBLE, h::DOUBLE]) AS value FROM n8")
def f21_sleep_trajectory(spark, d):
    n = _notes(spark, d)
    return n.select("doc_id", F.explode(X.sleep(F.lit(None).cast("string"), F.col("body"))).alias("value"))


@query(f"WITH {NOTES} SELECT doc_id, array_to_string(CASE WHEN trim(m) <> '' THEN [m] ELSE [] END || CASE WHEN doc_id % 3 = 0 THEN ['celebratory', 'warm'] WHEN doc_id % 3 = 1 THEN ['sad', 'tired'] ELSE [] END, ',') AS moods FROM n8")
def f21_mood_trajectory(spark, d):
    return _notes(spark, d).select("doc_id", F.array_join(X.moods(F.array("m"), F.col("body")), ",").alias("moods"))


@query(f"WITH {NOTES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Home,' ELSE '' END || p AS places, CASE WHEN j = 'The' THEN 'garden' ELSE 'garden,' || j END AS projects FROM n8")
def f21_place_and_project(spark, d):
    n = _notes(spark, d)
    return n.select("doc_id", F.array_join(X.places(F.when(F.col("doc_id") % 2 == 0, " Home "), F.col("body")), ",").alias("places"), F.array_join(X.projects(F.lit(None).cast("string"), F.array(F.lit("Work"), F.lit(" garden ")), F.col("body")), ",").alias("projects"))


@query("SELECT item_id, 'Item ' || item_id AS heading, text AS paragraph FROM benchmark")
def f10_heading_and_paragraph(spark, d):
    n = F.col("item_id").cast("string")
    b = D.table(spark, d, "benchmark").select("item_id", F.concat(F.lit("\n# Item "), n, F.lit("\n\n## Part\n\n"), "text", F.lit("\n \nmore")).alias("body"))
    return b.select("item_id", X.heading(F.col("body")).alias("heading"), X.first_paragraph(F.col("body")).alias("paragraph"))


@query(f"""WITH r AS (SELECT year(date) AS y, month(date) AS m, topic, mood, location, person, tag, date FROM {OR}), k AS (SELECT unnest(['month', 'year', 'root']) AS level), x AS (SELECT level, CASE level WHEN 'month' THEN strftime(date, '%Y-%m') WHEN 'year' THEN strftime(date, '%Y') ELSE 'all' END AS key, * FROM r, k),
t AS (SELECT level, key, string_agg(topic || ':' || n, ',' ORDER BY topic) AS topics FROM (SELECT level, key, topic, count(*) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2), o AS (SELECT level, key, string_agg(mood || ':' || n, ',' ORDER BY mood) AS moods FROM (SELECT level, key, mood, count(*) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT level, key, count(*) AS n, count(DISTINCT location) AS n_locations, count(DISTINCT person) AS n_people, count(DISTINCT tag) AS n_tags, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, any_value(topics) AS topics, any_value(moods) AS moods FROM x JOIN t USING (level, key) JOIN o USING (level, key) GROUP BY 1, 2""")
def a11_a12_calendar_nodes(spark, d):
    """Months, years and the whole: counts, unique signals, dates, topics and moods. Values are counted by month first and summed upwards."""
    o = D.order_entries(spark, d).withColumn("month", F.date_format("date", "yyyy-MM"))
    keys = F.explode(F.array(F.struct(F.lit("month").alias("level"), F.col("month").alias("key")), F.struct(F.lit("year").alias("level"), F.substring("month", 1, 4).alias("key")), F.struct(F.lit("root").alias("level"), F.lit("all").alias("key"))))
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("topic", "mood", "location", "person", "tag"))))
    cells = o.select("month", kinds.alias("v")).groupBy("month", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select(keys.alias("k"), "kind", "value", "n").groupBy("k.level", "k.key", "kind", "value").agg(F.sum("n").alias("n"))
    shown = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n")))), lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ",")
    nodes = cells.groupBy("level", "key").agg(F.sum(F.when(F.col("kind") == "topic", F.col("n"))).alias("n"), *(F.count_if(F.col("kind") == c).alias(f"n_{a}") for c, a in (("location", "locations"), ("person", "people"), ("tag", "tags"))), shown("topic").alias("topics"), shown("mood").alias("moods"))
    dates = o.groupBy("month").agg(F.min("date").alias("a"), F.max("date").alias("z")).select(keys.alias("k"), "a", "z").groupBy("k.level", "k.key").agg(F.min("a").cast("string").alias("first_date"), F.max("z").cast("string").alias("last_date"))
    return nodes.join(dates, ["level", "key"])


@query(f"SELECT kind, value, count(*) AS n, count(DISTINCT strftime(date, '%Y-%m')) AS n_nodes, array_to_string(list_sort(list(doc_id))[1:3], ',') AS evidence FROM (SELECT 'topic' AS kind, topic AS value, doc_id, date FROM {OR} UNION ALL SELECT 'people', person, doc_id, date FROM {OR} UNION ALL SELECT 'project', location, doc_id, date FROM {OR}) GROUP BY 1, 2")
def a9_lens_of_signals(spark, d):
    o = D.order_entries(spark, d)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("topic", "topic"), ("people", "person"), ("project", "location")))))
    rows = o.select(kinds.alias("v"), "doc_id", F.date_format("date", "yyyy-MM").alias("month")).select("v.kind", "v.value", "doc_id", "month")
    n = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("month").alias("n_nodes"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("kind", "value").orderBy("doc_id"))).filter("k <= 3").groupBy("kind", "value").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("evidence"))
    return n.join(first, ["kind", "value"])


_SIGNALS = {"props_k": "json_extract_string(props, '$.k')", "hundred": "regexp_extract(CAST(value AS VARCHAR), '^[0-9]{3}', 0)", "time": "CAST(tm AS VARCHAR)", "topic": "topic"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) AS in_scope, count(*) FILTER (nullif({c}, '') IS NOT NULL) AS present, count(TRY_CAST({c} AS DOUBLE)) AS parseable FROM {EV}" for k, c in _SIGNALS.items()))
def a10_signals_parseable(spark, d):
    """Of each signal of the events how many have it and how many have a number: a key of their properties, the hundreds of their values, their time of day, their topic."""
    e = D.event_entries(spark, d).select(F.get_json_object("props", "$.k").alias("props_k"), F.regexp_extract(F.col("value").cast("string"), "^[0-9]{3}", 0).alias("hundred"), F.col("time_minutes").cast("string").alias("time"), "topic")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    sums = e.agg(F.count(F.lit(1)).alias("n"), *(x for c in e.columns for x in (F.count(given(c)).alias(f"p_{c}"), F.count(given(c).try_cast("double")).alias(f"q_{c}"))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col("n").alias("in_scope"), F.col(f"p_{c}").alias("present"), F.col(f"q_{c}").alias("parseable")) for c in e.columns))).alias("s")).select("s.*")


@query(f"SELECT doc_id, contains(lower(body || ' ' || title || ' ' || coalesce(topic, '')), 'src1') OR contains(lower(body || ' ' || title || ' ' || coalesce(topic, '')), 'apache') AS said FROM {ENT}")
def p11_p12_terms_of_an_entity(spark, d):
    """An entity is there if its id, name or an alias is in the body or in any text of the metadata."""
    terms = N.by_id([("src1", "Source One", ["apache"])], "SRC1")
    hay = F.lower(F.concat_ws(" ", "body", "title", F.coalesce("topic", F.lit(""))))
    said = F.lit(False)
    for t in terms:
        said = said | hay.contains(t.lower())
    return entries(spark, d).select("doc_id", said.alias("said"))


@query(f"SELECT doc_id FROM {OR} WHERE list_has_any([lower(topic), lower(mood), lower(tag)], ['1-urgent', 'f']) AND contains(lower(location), 'ion_2') AND NOT contains(lower(tag), 'machin')")
def p3_p4_p5_p13_lists_and_scalars(spark, d):
    """Any of the values, whatever the case, in a list; a part of a text in place and weather."""
    o = D.order_entries(spark, d).withColumn("labels", F.array("topic", "mood", "tag"))
    return o.filter(F.exists("labels", lambda x: F.lower(x).isin("1-urgent", "f")) & F.lower("location").contains("ion_2") & ~F.lower("tag").contains("machin")).select("doc_id")


def _paged_sql(name: str, source: str, group: str, key: str) -> str:
    """name(group, h): pages of 1,024 keys, pages of pages, and one digest over those."""
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""{name}0 AS (SELECT {g}{key} // 1024 AS page, sha256(string_agg(f, ',' ORDER BY {key})) AS h FROM {source} GROUP BY ALL), {name}1 AS (SELECT {g}{name}0.page // 1024 AS page, sha256(string_agg(h, ',' ORDER BY {name}0.page)) AS h FROM {name}0 GROUP BY {g}{name}0.page // 1024),
{name} AS (SELECT {g}sha256(string_agg(h, ',' ORDER BY page)) AS h FROM {name}1 {by})"""


@query(f"""WITH a AS (SELECT user_id, event_id, sha256('record' || chr(10) || event_id || chr(10) || props) AS f FROM events), {_paged_sql('s', 'a', 'user_id', 'event_id')}, p AS (SELECT user_id, sha256('source' || chr(10) || h) AS f FROM s), {_paged_sql('r', 'p', '', 'user_id')}
SELECT CAST(user_id AS VARCHAR) AS node, f AS fingerprint FROM p UNION ALL SELECT 'plan', sha256('plan' || chr(10) || h) FROM r""")
def a29_fingerprint_tree(spark, d):
    """Fingerprints of records, of sources over theirs, and of the plan over the sources': a change anywhere shows at the root. Digests are taken page by page."""
    of = lambda kind, *parts: F.sha2(F.concat_ws("\n", F.lit(kind), *parts), 256)
    a = D.table(spark, d, "events").select("user_id", "event_id", of("record", F.col("event_id").cast("string"), F.col("props")).alias("f"))
    p = T.paged_digest(a, ["user_id"], "event_id", value="f").select("user_id", of("source", F.col("digest")).alias("f"))
    root = T.paged_digest(p, [], "user_id", value="f").select(F.lit("plan").alias("node"), of("plan", F.col("digest")).alias("f"))
    return p.select(F.col("user_id").cast("string").alias("node"), "f").unionByName(root).withColumnRenamed("f", "fingerprint")


@query("SELECT key, doc_id, CASE WHEN key IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) THEN 'in_ledger' WHEN n = 1 THEN 'import' ELSE 'repeat' END AS outcome FROM (SELECT md5(text) AS key, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 10 <> 0)")
def t3_t4_ledger(spark, d):
    """What a second run imports: keys of the ledger are done, the first of each other key goes in, repeats don't."""
    t = D.table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id")
    ledger = t.filter("doc_id % 10 = 0").select("key").distinct().withColumn("done", F.lit(True))
    n = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    new = t.filter("doc_id % 10 <> 0").withColumn("n", n).join(ledger, "key", "left")
    return new.select("key", "doc_id", F.when(F.col("done"), "in_ledger").when(F.col("n") == 1, "import").otherwise("repeat").alias("outcome"))


@query("WITH r AS (SELECT conv_id * 1000 + turn AS s, conv_id * 1000 + unnest([turn + 1, turn + 1, turn - 1]) AS t FROM conversations), k AS (SELECT DISTINCT s, t FROM r WHERE t % 1000 > 0) SELECT s AS source, count(*) AS n_out, string_agg(CAST(t AS VARCHAR), ',' ORDER BY CAST(t AS VARCHAR)) AS targets FROM k WHERE s % 2 = 0 GROUP BY s UNION ALL SELECT s, 1, 'replaced' FROM (SELECT DISTINCT s FROM r WHERE s % 2 = 1)")
def j24_relation_table(spark, d):
    """One row a pair, blanks and repeats skipped; a source that is written again has its rows replaced."""
    s = F.col("conv_id") * 1000 + F.col("turn")
    c = D.table(spark, d, "conversations").select(s.alias("source"), F.array(s + 1, s + 1, s - 1).alias("related"))
    old = c.select("source", F.explode(F.array_distinct("related")).alias("target")).filter("target % 1000 > 0").distinct().withColumn("target", F.col("target").cast("string"))
    again = c.filter("source % 2 = 1").select("source", F.lit("replaced").alias("target")).distinct()
    table = old.join(again.select("source").distinct(), "source", "left_anti").unionByName(again)
    return table.groupBy("source").agg(F.count(F.lit(1)).alias("n_out"), F.array_join(F.sort_array(F.collect_list("target")), ",").alias("targets"))


@query("""WITH j AS (SELECT lang AS category, source, quality FROM labels JOIN documents USING (doc_id)), a AS (SELECT category, avg(quality) FILTER (source < 'src3') AS base, avg(quality) FILTER (source >= 'src3') AS cand, count(*) AS n FROM j GROUP BY 1)
SELECT category, n, round(base, 4) AS base, round(cand, 4) AS candidate, round(cand - base, 4) AS delta, CASE WHEN cand > base THEN 'better' WHEN cand < base THEN 'worse' ELSE 'same' END AS verdict FROM a""")
def a22_a23_deltas_by_category(spark, d):
    j = D.table(spark, d, "labels").join(D.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    a = j.groupBy(F.col("lang").alias("category")).agg(F.avg(F.when(F.col("source") < "src3", F.col("quality"))).alias("b"), F.avg(F.when(F.col("source") >= "src3", F.col("quality"))).alias("c"), F.count(F.lit(1)).alias("n"))
    return a.select("category", "n", F.round("b", 4).alias("base"), F.round("c", 4).alias("candidate"), F.round(F.col("c") - F.col("b"), 4).alias("delta"), F.when(F.col("c") > F.col("b"), "better").when(F.col("c") < F.col("b"), "worse").otherwise("same").alias("verdict"))


@query("SELECT lang AS category, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS n_strict, count(*) FILTER (quality = 1 OR toxic = 0) AS n_soft, count(*) FILTER (quality IS NULL) AS n_errors, round(avg((quality = 1 AND toxic = 0)::INT), 4) AS strict_rate, round(avg((quality = 1 OR toxic = 0)::INT), 4) AS soft_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a33_strict_and_soft_rates(spark, d):
    j = D.table(spark, d, "labels").join(D.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    strict, soft = (F.col("quality") == 1) & (F.col("toxic") == 0), (F.col("quality") == 1) | (F.col("toxic") == 0)
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    return j.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(strict).alias("n_strict"), F.count_if(soft).alias("n_soft"), F.count_if(F.col("quality").isNull()).alias("n_errors"), rate(strict).alias("strict_rate"), rate(soft).alias("soft_rate"))


@query(f"SELECT * FROM (SELECT user_id, CAST(max(date) AS VARCHAR) AS last_day, CAST(any_value(now) - max(date) AS BIGINT) AS streak, any_value(now) - max(date) >= 2 AS silent FROM {EV}, (SELECT max(date) AS now FROM {EV}) GROUP BY user_id)")
def w4_streak_since_newest(spark, d):
    e = D.event_entries(spark, d)
    now = e.agg(F.max("date").alias("now"))
    s = e.groupBy("user_id").agg(F.max("date").alias("last")).crossJoin(F.broadcast(now))
    gap = F.datediff("now", "last").cast("long")
    return s.select("user_id", F.col("last").cast("string").alias("last_day"), gap.alias("streak"), (gap >= 2).alias("silent"))


@query("SELECT doc_id, starts_with(text, chr(65279)) AS bom, false AS broken, regexp_matches(text, 'Ã©|Ã¨|â€|ï¿½') AS mojibake, 'low' AS risk FROM documents WHERE text IS NOT NULL UNION ALL SELECT -1, false, true, false, 'high'")
def q8_encoding_of_bytes(spark, d):
    raw = D.table(spark, d, "documents").filter("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("raw")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.unhex(F.lit("41C32841")).alias("raw")))
    text = F.decode(F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw")), "UTF-8")
    broken = ~F.is_valid_utf8(F.col("raw").cast("string"))
    return raw.select("doc_id", F.coalesce(F.startswith(F.hex("raw"), F.lit("EFBBBF")), F.lit(False)).alias("bom"), broken.alias("broken"), F.coalesce(text.rlike("Ã©|Ã¨|â€|ï¿½"), F.lit(False)).alias("mojibake"), F.when(broken, "high").otherwise("low").alias("risk"))


@query(r"SELECT doc_id, regexp_replace('key ghp_' || md5(text) || ' end', '(ghp_[A-Za-z0-9]{4})[A-Za-z0-9]{16,}', '\1[redacted]', 'g') AS shown FROM documents WHERE text IS NOT NULL")
def q10_redacted_tokens(spark, d):
    t = D.table(spark, d, "documents").filter("text is not null").select("doc_id", F.concat(F.lit("key ghp_"), F.md5("text"), F.lit(" end")).alias("t"))
    return t.select("doc_id", F.regexp_replace("t", r"(ghp_[A-Za-z0-9]{4})[A-Za-z0-9]{16,}", "$1[redacted]").alias("shown"))
