"""Every query by name, each with SQL that gives the same rows. Names start with the operator's id in the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate as A
from ..operators import changes as C
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import quality as Q
from ..operators import search as S
from ..sources import adapters as D
from ..sources.store import dealt
from ..streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Plans and rules on stated phrases and small graphs, with SQL that lists what must come out. They read no table: tests run them.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_SQL: dict[str, str] = {}


def case(sql: str):
    def add(f):
        CASES[f.__name__], CASE_SQL[f.__name__] = f, sql
        return f

    return add


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EV = "(SELECT event_id AS doc_id, CAST(ts AS DATE) AS date, CASE WHEN event_type <> 'error' THEN hour(ts) * 60 + minute(ts) END AS tm, event_type AS topic, value, ts, user_id, props FROM events)"
OR = "(SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS topic, o_orderstatus AS mood, c_name AS person, n_name AS location, c_mktsegment AS tag, o_totalprice AS value, o_custkey AS person_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
TITLE = r"substr(trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '')), 1, 50)"
ABSTRACT = r"substr(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), 1, 100)"
DOC = f"(SELECT doc_id, {TITLE} AS title, {ABSTRACT} AS abstract, text AS body, lang AS tag, source AS project FROM documents)"
TERMS = ["the", "apache", "licensed"]


# aggregates -----------------------------------------------------------------------------------------------------------
def _buckets(unit: str, fmt: str):
    sql = f"SELECT strftime(date, '{fmt}') AS bucket, count(*) FILTER (topic = 'error') AS n_matched, 0::BIGINT AS n_unknown, count(*) AS n_total, count(*) FILTER (topic = 'error') > 0 AS any_match FROM {EV} GROUP BY 1"

    def f(spark, d):
        return A.buckets(D.event_entries(spark, d), F.lower("topic") == "error", unit)

    f.__name__ = f"a1_bucket_{unit}_field_equals"
    query(sql)(f)


for _u, _f in (("day", "%Y-%m-%d"), ("week", "%G-W%V"), ("month", "%Y-%m")):
    _buckets(_u, _f)


@query(f"SELECT strftime(date, '%G-W%V') AS bucket, count(*) FILTER (value > 200000) AS n_matched, 0::BIGINT AS n_unknown, count(*) AS n_total, count(*) FILTER (value > 200000) > 0 AS any_match FROM {OR} GROUP BY 1")
def a2_iso_week_over_years(spark, d):
    return A.buckets(D.order_entries(spark, d), F.col("value") > 200000, "week")


def _summary(unit: str, n: str, den: str):
    sql = f"SELECT CAST({n} AS BIGINT) AS n, CAST({n} AS BIGINT) AS n_min, CAST({n} AS BIGINT) AS n_max, CAST({den} AS BIGINT) AS denominator FROM {EV}"

    def f(spark, d):
        return A.summary(D.event_entries(spark, d), F.col("topic") == "purchase", unit)

    f.__name__ = f"a3_summary_{unit}"
    query(sql)(f)


_summary("day", "count(DISTINCT date) FILTER (topic = 'purchase')", "max(date) - min(date) + 1")
_summary("week", "count(DISTINCT strftime(date, '%G-W%V')) FILTER (topic = 'purchase')", "(max(date) - min(date) + 7) // 7")
_summary("month", "count(DISTINCT strftime(date, '%Y-%m')) FILTER (topic = 'purchase')", "count(DISTINCT strftime(date, '%Y-%m'))")
_summary("entry", "count(*) FILTER (topic = 'purchase')", "count(*)")


@query(f"""WITH b AS (SELECT date, count(*) FILTER (tm >= 1430) AS m, count(*) FILTER (tm IS NULL) AS u FROM {EV} GROUP BY 1)
SELECT count(*) FILTER (m > 0) AS n, count(*) FILTER (m > 0) AS n_min, count(*) FILTER (m > 0 OR u > 0) AS n_max,
(SELECT CAST(max(date) - min(date) + 1 AS BIGINT) FROM {EV}) AS denominator FROM b""")
def p10_entry_time_after_bounds(spark, d):
    return A.summary(D.event_entries(spark, d), F.col("time_minutes") >= 1430, "day")


@query(f"SELECT CASE WHEN tm >= 720 THEN 'matched' WHEN tm < 720 THEN 'excluded' ELSE 'unknown' END AS role, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM {EV} GROUP BY 1")
def a6_evidence_roles(spark, d):
    r = A.roles(D.event_entries(spark, d), F.col("time_minutes") >= 720)
    return r.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT source, count(*) FILTER (contains(lower(text), 'license')) AS n, count(*) AS total FROM documents GROUP BY source")
def p11_term_presence(spark, d):
    return D.table(spark, d, "documents").groupBy("source").agg(F.count_if(F.lower("text").contains("license")).alias("n"), F.count(F.lit(1)).alias("total"))


@query(f"SELECT strftime(date, '%Y-%m-%d') AS bucket, count(*) AS n FROM {EV} WHERE 'user' || user_id IN ('user1', 'user2', 'user3') GROUP BY 1")
def p12_entity_presence(spark, d):
    names = spark.createDataFrame([("user1",), ("user2",), ("user3",)], "person string")
    return D.event_entries(spark, d).join(F.broadcast(names), "person", "left_semi").groupBy(T.bucket(F.col("date"), "day").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, location, value FROM {OR} WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND topic IN ('1-URGENT', '2-HIGH') AND contains(lower(location), 'ion_1') AND mood = 'F'")
def p1_p5_metadata_filter(spark, d):
    o = D.order_entries(spark, d)
    return o.filter(F.col("date").between("1996-01-01", "1996-06-30") & F.col("topic").isin("1-URGENT", "2-HIGH") & F.lower("location").contains("ion_1") & (F.col("mood") == "F")).select("doc_id", "location", "value")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])apache([^a-z0-9]|$)') OR contains(lower(text), 'é la')")
def p6_p7_token_match(spark, d):
    t = D.table(spark, d, "documents")
    return t.filter(T.token_match(F.col("text"), "apache") | T.token_match(F.col("text"), "é la")).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def p8_unfiltered_cap(spark, d):
    return D.table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(100)


@query("SELECT conv_id FROM (SELECT conv_id, list(DISTINCT role) AS r FROM conversations GROUP BY 1) WHERE list_has_any(r, ['system'])")
def p14_facet_any(spark, d):
    c = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return c.filter(F.arrays_overlap("r", F.array(F.lit("system")))).select("conv_id")


@query("SELECT conv_id FROM (SELECT conv_id, list(DISTINCT role) AS r FROM conversations GROUP BY 1) WHERE list_has_all(r, ['user', 'assistant'])")
def p14_facet_all(spark, d):
    c = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return c.filter(F.size(F.array_except(F.array(F.lit("user"), F.lit("assistant")), "r")) == 0).select("conv_id")


def _noise_sql(q: str, given: str) -> str:
    has = lambda signals: f"regexp_matches({q}, '{'|'.join(signals)}')"
    alike = f"(1 - levenshtein(lower({q}), '{T.CANONICAL}') / greatest(length({q}), {len(T.CANONICAL)}))"
    solid, latin = f"replace({q}, ' ', '')", rf"NOT regexp_matches({q}, '[\x{{4e00}}-\x{{9fff}}]')"
    return rf"""SELECT *, CASE WHEN {q} = '' THEN 'empty_query' WHEN regexp_matches({q}, '^[\p{{P}}{T.SPACE}]+$') THEN 'pure_symbols' WHEN regexp_matches({q}, '^[{T.DIGIT}]+$') THEN 'pure_digits' WHEN replace({q}, substr({q}, 1, 1), '') = '' THEN 'repeated_char'
WHEN length(regexp_replace({q}, '[\p{{P}}{T.SPACE}]', '', 'g')) < 3 THEN 'too_short' WHEN {latin} AND regexp_matches({solid}, '^[\p{{L}}\p{{N}}]+$') AND 2 * length(regexp_replace({solid}, '[^{T.DIGIT}]', '', 'g')) >= length({solid}) THEN 'alphanumeric_noise' WHEN {latin} AND NOT regexp_matches({q}, '[a-zA-Z]{{3}}') THEN 'no_dictionary_words'
WHEN {has(T.NEGATIONS)} THEN 'negation_intent' WHEN {has(T.OFF_TOPIC)} THEN 'ood_topic' WHEN regexp_matches({q}, '^[\x00-\x7f]+$') AND abs(length({q}) - {len(T.CANONICAL)}) <= 2 AND {alike} >= 0.65 AND {alike} < 0.85 THEN 'typo_near_noise' ELSE 'none' END AS noise FROM (SELECT * REPLACE (regexp_replace(coalesce({q}, ''), '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g') AS {q}) FROM ({given}))"""


@query(f"SELECT item_id, size, noise FROM ({_noise_sql('q', 'SELECT item_id, size, substr(text, 1, size) AS q FROM benchmark, (SELECT unnest([0, 2, 4, 10, 1000000000]) AS size)')})")
def p16_noise_gate(spark, d):
    """The eight rules of P16 on heads of the benchmark's texts, taken as queries."""
    heads = D.table(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, (0, 2, 4, 10, 1_000_000_000)))).alias("size"))
    return heads.select("item_id", "size", T.noise(F.expr("substring(text, 1, size)")).alias("noise"))


@query(f"SELECT doc_id, CAST(contains(lower(title || ' ' || abstract), 'the') AS INT) + CAST(contains(lower(title || ' ' || abstract), 'ing') AS INT) + CAST(contains(lower(title || ' ' || abstract), 'tion') AS INT) AS hits FROM {DOC} WHERE hits >= 2")
def p17_min_token_hits(spark, d):
    hay = F.lower(F.concat_ws(" ", "title", "abstract"))
    words = ["the", "ing", "tion"]
    need = max(2, -(-4 * len(words) // 10))
    hits = sum((hay.contains(w).cast("int") for w in words), F.lit(0))
    return D.document_entries(spark, d).select("doc_id", hits.alias("hits")).filter(F.col("hits") >= need)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
x AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, CAST(n AS BIGINT) AS line_no, length(line) AS size, length(before) AS size_before, length(after) AS size_after FROM x WHERE contains(lower(line), 'license')""")
def s6_line_context(spark, d):
    lines = F.split("text", "\n")
    hits = D.table(spark, d, "documents").filter(F.lower("text").contains("license")).select("doc_id", lines.alias("ls")).select("doc_id", "ls", F.posexplode("ls").alias("p", "line")).filter(F.lower("line").contains("license"))
    at = lambda k: F.length(F.when(F.col("p") + k >= 0, F.get("ls", F.col("p") + k))).cast("long")
    return hits.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.length("line").cast("long").alias("size"), at(-1).alias("size_before"), at(1).alias("size_after"))


# facets, roll-ups, calendar -------------------------------------------------------------------------------------------
def _facet(column: str):
    sql = f"WITH v AS (SELECT DISTINCT {column} AS value, doc_id FROM {OR}) SELECT value, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:5], ',') AS samples, row_number() OVER (ORDER BY count(*) DESC, value) AS place FROM v GROUP BY value"

    def f(spark, d):
        return A.facet(D.order_entries(spark, d), column)

    f.__name__ = f"a7_facet_menu_{column}"
    query(sql)(f)


for _c in ("topic", "location", "mood", "tag"):
    _facet(_c)


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(*) AS df FROM t WHERE length(term) >= 3 GROUP BY term ORDER BY df DESC, term LIMIT 5000""")
def a8_content_term_menu(spark, d):
    t = D.table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).filter(F.length("term") >= 3)
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(5000)


@query(f"SELECT topic AS value, count(*) AS n, count(DISTINCT strftime(date, '%Y-%m')) AS months, min(strftime(date, '%Y-%m')) AS first_month FROM {OR} GROUP BY 1")
def a9_lens(spark, d):
    m = F.date_format("date", "yyyy-MM")
    return D.order_entries(spark, d).groupBy(F.col("topic").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(m).alias("months"), F.min(m).alias("first_month"))


@query(f"SELECT unnest(['topic', 'time_minutes']) AS signal, unnest([count(*), count(*)]) AS in_scope, unnest([count(topic), count(tm)]) AS present FROM {EV}")
def a10_signal_coverage(spark, d):
    return A.coverage(D.event_entries(spark, d), ["topic", "time_minutes"])


@query(f"SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(grouping(year(date), month(date)) AS BIGINT) AS level, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(DISTINCT location) AS n_locations FROM {OR} GROUP BY ROLLUP (year(date), month(date))")
def a11_a12_calendar_rollup(spark, d):
    return A.rollup(D.order_entries(spark, d))


@query(f"""SELECT doc_id, CAST(2000 - year(date) AS BIGINT) AS years_ago, row_number() OVER (ORDER BY date DESC, doc_id) AS place FROM {OR}
WHERE strftime(date, '%m-%d') = '02-29' OR (strftime(date, '%m-%d') = '03-01' AND year(date) < 2000) QUALIFY place <= 20""")
def j21_on_this_day(spark, d):
    o = D.order_entries(spark, d).filter((F.date_format("date", "MM-dd") == "02-29") | ((F.date_format("date", "MM-dd") == "03-01") & (F.year("date") < 2000)))
    top = o.orderBy(F.desc("date"), "doc_id").limit(20)
    return top.select("doc_id", (2000 - F.year("date")).cast("long").alias("years_ago"), F.row_number().over(Window.orderBy(F.desc("date"), "doc_id")).cast("long").alias("place"))


@query(f"SELECT doc_id, CAST(date AS VARCHAR) AS day, topic FROM {OR} WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' AND topic = '3-MEDIUM' ORDER BY date, doc_id")
def o4_timeline(spark, d):
    return D.order_entries(spark, d).filter(F.col("date").between("1997-03-01", "1997-05-31") & (F.col("topic") == "3-MEDIUM")).orderBy("date", "doc_id").select("doc_id", F.col("date").cast("string").alias("day"), "topic")


@query(f"SELECT doc_id, value FROM {OR} ORDER BY value DESC, doc_id LIMIT 20 OFFSET 10")
def o7_offset_limit(spark, d):
    return D.order_entries(spark, d).orderBy(F.desc("value"), "doc_id").offset(10).limit(20).select("doc_id", "value")


@query(f"SELECT user_id, CAST(before AS VARCHAR) AS before, CAST(date AS VARCHAR) AS day, CAST(date - before AS BIGINT) AS gap FROM (SELECT user_id, date, lag(date) OVER (PARTITION BY user_id ORDER BY date) AS before FROM (SELECT DISTINCT user_id, date FROM {EV})) WHERE date - before >= 2")
def w4_silence_gap(spark, d):
    days = D.event_entries(spark, d).select("user_id", "date").distinct()
    w = Window.partitionBy("user_id").orderBy("date")
    g = days.withColumn("before", F.lag("date").over(w)).withColumn("gap", F.datediff("date", "before").cast("long"))
    return g.filter("gap >= 2").select("user_id", F.col("before").cast("string").alias("before"), F.col("date").cast("string").alias("day"), "gap")


@query(f"SELECT doc_id, CAST(date AS VARCHAR) AS day, row_number() OVER (PARTITION BY date ORDER BY doc_id) AS seq FROM {EV}")
def w6_sequence_in_day(spark, d):
    return D.event_entries(spark, d).select("doc_id", F.col("date").cast("string").alias("day"), F.row_number().over(Window.partitionBy("date").orderBy("doc_id")).cast("long").alias("seq"))


# search ---------------------------------------------------------------------------------------------------------------
BM = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'apache')) AS b, len(list_filter(w, lambda x: x = 'licensed')) AS c FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM c),
bm AS (SELECT doc_id, CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS BIGINT) AS n_terms,
  round(0.0::DOUBLE + ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))
  + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))
  + ln(1 + (n - dc + 0.5::DOUBLE) / (dc + 0.5::DOUBLE)) * c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al)), 4) AS score FROM c, s WHERE a + b + c > 0)"""


def _bm(spark, d):
    return S.bm25(D.document_entries(spark, d), TERMS)


@query(f"WITH {BM} SELECT * FROM bm")
def r2_bm25_or(spark, d):
    return _bm(spark, d)


@query(f"WITH {BM} SELECT * FROM bm WHERE n_terms = 3")
def r6_bm25_and(spark, d):
    return _bm(spark, d).filter("n_terms = 3")


@query(f"WITH {BM} SELECT * FROM bm WHERE n_terms = 3 OR (SELECT count(*) FILTER (n_terms = 3) < 3 FROM bm)")
def u2_and_then_or(spark, d):
    return S.and_then_or(_bm(spark, d), 3)


@query(f"WITH {BM} SELECT doc_id, score, CAST(greatest(0, least(100, floor(70 + 5 * score))) AS BIGINT) AS relevance, row_number() OVER (ORDER BY score DESC, doc_id) AS search_rank, CASE WHEN score >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM bm ORDER BY search_rank LIMIT 100")
def r2_bm25_ranked_search(spark, d):
    top = _bm(spark, d).orderBy(F.desc("score"), "doc_id").limit(100)
    return S.ranked(top).select("doc_id", "score", S.relevance(F.col("score")).alias("relevance"), "search_rank", S.confidence(F.col("score")).alias("confidence"))


BONUS = f"(SELECT doc_id, CAST(30 AS DOUBLE) + {' + '.join(f'CASE WHEN contains(lower({c}), {t!r}) THEN {v}::DOUBLE ELSE 0 END' for t in TERMS for c, v in (('title', 8), ('abstract', 4), ('tag', 3)))} AS bonus FROM {DOC})"


@query(f"SELECT * FROM {BONUS} WHERE bonus > 30")
def r9_metadata_bonus(spark, d):
    return S.metadata_bonus(D.document_entries(spark, d), TERMS)


@query(f"""WITH {BM}, r AS (SELECT score AS s, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM bm WHERE score > 0)
SELECT n, max(s) FILTER (k = n // 4 + 1) AS q1, max(s) FILTER (k = 3 * n // 4 + 1) AS q3, round(CASE WHEN n >= 8 THEN greatest(0.01::DOUBLE, max(s) FILTER (k = n // 4 + 1) - 1.5::DOUBLE * (max(s) FILTER (k = 3 * n // 4 + 1) - max(s) FILTER (k = n // 4 + 1))) ELSE 0.01::DOUBLE END, 4) AS fence FROM r GROUP BY n""")
def r13_w3_tukey_threshold(spark, d):
    return S.tukey(_bm(spark, d), base=0.01)


@query(f"""WITH {BM}, l2 AS (SELECT * FROM {BONUS} WHERE bonus > 30), l1 AS (SELECT doc_id, 10.0::DOUBLE AS s1 FROM documents WHERE source = 'src1')
SELECT doc_id, CAST(CASE WHEN bm.score IS NOT NULL THEN 3 WHEN l2.bonus IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS tier,
round(CASE WHEN bm.score IS NOT NULL THEN bm.score + greatest(coalesce(l2.bonus - 30, 0), 0) ELSE coalesce(l2.bonus, s1) END, 4) AS score
FROM bm FULL JOIN l2 USING (doc_id) FULL JOIN l1 USING (doc_id)""")
def j1_three_tier_merge(spark, d):
    e = D.document_entries(spark, d)
    return C.merge_tiers(_bm(spark, d), S.metadata_bonus(e, TERMS), e.filter("project = 'src1'").select("doc_id"))


@query(f"WITH {BM} SELECT doc_id, score FROM bm SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') e USING (doc_id)")
def j2_u3_candidate_semi_join(spark, d):
    return _bm(spark, d).join(D.table(spark, d, "documents").filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "score")


@query("""WITH q AS (SELECT 'a' AS q, doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT 'b', doc_id, CAST(n_chars AS DOUBLE) FROM documents WHERE contains(lower(text), 'reserved') UNION ALL SELECT 'c', doc_id, CAST(n_chars AS DOUBLE) FROM documents WHERE lang = 'de')
SELECT doc_id, string_agg(DISTINCT q, ',' ORDER BY q) AS source_queries, max(score) AS score, row_number() OVER (ORDER BY max(score) DESC, doc_id) AS place FROM q GROUP BY doc_id ORDER BY place LIMIT 15""")
def u5_multi_query_fusion(spark, d):
    t = D.table(spark, d, "documents").withColumn("score", F.col("n_chars").cast("double"))
    return C.fuse({"a": t.filter(F.lower("text").contains("license")), "b": t.filter(F.lower("text").contains("reserved")), "c": t.filter("lang = 'de'")})


@query(f"WITH {BM} SELECT doc_id FROM bm EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def u6_shadow_recall(spark, d):
    return _bm(spark, d).select("doc_id").exceptAll(D.table(spark, d, "documents").filter("lang = 'en'").select("doc_id"))


@query("SELECT DISTINCT doc_id, min(tier) AS tier FROM (SELECT doc_id, 1::BIGINT AS tier FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 2 FROM documents WHERE n_chars > 5000) GROUP BY doc_id")
def u1_union_first_wins(spark, d):
    t = D.table(spark, d, "documents")
    return t.filter("lang = 'fr'").select("doc_id", F.lit(1).cast("long").alias("tier")).unionByName(t.filter("n_chars > 5000").select("doc_id", F.lit(2).cast("long").alias("tier"))).groupBy("doc_id").agg(F.min("tier").alias("tier"))


# joins and graph ------------------------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT conv_id * 1000 + turn AS s, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)
SELECT t AS target, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS backlinks FROM r WHERE t IS NOT NULL GROUP BY t""")
def j3_j24_backlinks(spark, d):
    c = D.table(spark, d, "conversations").withColumn("s", F.col("conv_id") * 1000 + F.col("turn"))
    r = c.withColumn("t", F.lead("s").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("t is not null").select("s", "t").distinct()
    return r.groupBy(F.col("t").alias("target")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x.cast("string")), ",").alias("backlinks"))


@query("SELECT c_custkey AS id, b.n_name AS name FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON lower(a.n_name) = lower(b.n_name)")
def j4_g1_name_lookup(spark, d):
    n, c = D.table(spark, d, "nation"), D.table(spark, d, "customer")
    lookup = n.select(F.lower("n_name").alias("key"), F.col("n_name").alias("name"))
    mentions = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.lower("n_name").alias("key"))
    return mentions.join(lookup, "key").select("id", "name")


EDGES = "e0 AS (SELECT 'nation-' || n_nationkey AS source, 'member_of' AS relation, 'region-' || n_regionkey AS target FROM nation UNION ALL SELECT 'supplier-' || s_suppkey, 'lives_in', 'nation-' || s_nationkey FROM supplier)"
NODES = "n0 AS (SELECT 'region-' || r_regionkey AS id, 'place' AS type, r_name AS name FROM region UNION ALL SELECT 'nation-' || n_nationkey, 'place', n_name FROM nation UNION ALL SELECT 'supplier-' || s_suppkey, 'actor', s_name FROM supplier)"


def _hops(k: int):
    sql = f"""WITH RECURSIVE {EDGES}, b AS (SELECT source, relation, target FROM e0 UNION ALL SELECT target, relation, source FROM e0),
w AS (SELECT 'nation-3' AS id, 0::BIGINT AS hops, '' AS path UNION SELECT target, hops + 1, CASE WHEN path = '' THEN relation ELSE path || '>' || relation END FROM w JOIN b ON b.source = w.id WHERE hops < {k})
SELECT id, min(hops) AS hops, arg_min(path, (hops, path)) AS path FROM w WHERE id <> 'nation-3' GROUP BY id"""

    def f(spark, d):
        return G.neighbours(D.edges(spark, d), "nation-3", k)

    f.__name__ = f"j7_g2_neighbours_{k}"
    query(sql)(f)


for _k in (1, 2, 3):
    _hops(_k)


@query("SELECT 'order-' || o_orderkey AS source, 'ships' AS relation, 'lines-' || o_orderkey AS target FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j12_g4_dangling(spark, d):
    key = lambda p, c: F.concat(F.lit(f"{p}-"), F.col(c).cast("string"))
    links = D.table(spark, d, "orders").select(key("order", "o_orderkey").alias("source"), F.lit("ships").alias("relation"), key("lines", "o_orderkey").alias("target"))
    return G.dangling(links, D.table(spark, d, "lineitem").select(key("lines", "l_orderkey").alias("id"))).select("source", "relation", "target")


@query("SELECT lower(p_name) AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING n > 1")
def q13_duplicate_alias(spark, d):
    return G.duplicate_names(D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query(f"WITH d AS (SELECT DISTINCT user_id, date, topic FROM {EV}) SELECT a.topic AS a, b.topic AS b, count(*) AS n_groups, round(least(1.0::DOUBLE, count(*) / 5), 4) AS confidence, CASE WHEN count(*) >= 3 THEN 'confirm' WHEN count(*) = 2 THEN 'review' ELSE 'low' END AS action FROM d a JOIN d b ON a.user_id = b.user_id AND a.date = b.date AND a.topic < b.topic GROUP BY 1, 2")
def j11_a14_cooccurrence(spark, d):
    return G.cooccurrence(D.event_entries(spark, d), ["user_id", "date"], "topic")


@query(f"""WITH o AS (SELECT * FROM {OR}), p AS (SELECT a.doc_id, b.doc_id AS related, 40 + CASE WHEN a.topic = b.topic THEN 20 ELSE 0 END + CASE WHEN a.tag = b.tag THEN 15 ELSE 0 END + greatest(1, 10 - least(abs(a.date - b.date), 9)) AS score, abs(a.date - b.date) AS dist FROM o a JOIN o b ON a.person_id = b.person_id AND a.doc_id <> b.doc_id)
SELECT doc_id, related, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, dist, related) AS place FROM p QUALIFY place <= 5""")
def j9_o9_related_entries(spark, d):
    # pairs are ranked where they are made, so their number tells how much a task sorts
    o = dealt(D.order_entries(spark, d).select("doc_id", "person_id", "topic", "tag", "date"), "person_id")
    a, b = o.alias("a"), o.withColumnRenamed("doc_id", "related").alias("b")
    gap = F.abs(F.datediff("a.date", "b.date"))
    p = a.join(b, (F.col("a.person_id") == F.col("b.person_id")) & (F.col("doc_id") != F.col("related")))
    score = 40 + F.when(F.col("a.topic") == F.col("b.topic"), 20).otherwise(0) + F.when(F.col("a.tag") == F.col("b.tag"), 15).otherwise(0) + F.greatest(F.lit(1), 10 - F.least(gap, F.lit(9)))
    p = p.select("doc_id", "related", score.cast("long").alias("score"), gap.alias("dist"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "dist", "related")
    return p.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5").drop("dist")


@query(f"""WITH o AS (SELECT * FROM {OR}), p AS (SELECT a.doc_id, b.doc_id AS related, abs(a.date - b.date) AS dist, CASE WHEN a.person_id = b.person_id THEN 40 ELSE 0 END + CASE WHEN a.location = b.location THEN 30 ELSE 0 END + CASE WHEN a.topic = b.topic THEN 20 ELSE 0 END + CASE WHEN a.tag = b.tag AND a.mood = b.mood THEN 15 ELSE 0 END
+ CASE WHEN dist <= 30 THEN greatest(1, 10 - least(dist, 9)) ELSE 0 END AS score FROM o a JOIN o b ON a.doc_id <> b.doc_id),
t AS (SELECT doc_id, unnest(min({{'s': -score, 'dist': dist, 'r': -related}}, 5)) AS x FROM p WHERE score > 0 GROUP BY doc_id)
SELECT doc_id, -x.r AS related, CAST(-x.s AS BIGINT) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY x.s, x.dist, x.r) AS place FROM t""")
def j9_related_entries_any_signal(spark, d):
    """All signals of J9, none required: the customer is the people, the nation the project, segment and status are the tags."""
    o = D.order_entries(spark, d).select("doc_id", "date", "person_id", F.col("location").alias("project"), "topic", F.struct("tag", "mood").alias("tags"))
    return G.related(o, {"person_id": 40, "project": 30, "topic": 20, "tags": 15})


@query(f"WITH {EDGES}, {NODES} SELECT type, count(*) AS n, CAST(coalesce(sum(o), 0) AS BIGINT) AS n_out, CAST(coalesce(sum(i), 0) AS BIGINT) AS n_in FROM n0 LEFT JOIN (SELECT source AS id, count(*) AS o FROM e0 GROUP BY 1) USING (id) LEFT JOIN (SELECT target AS id, count(*) AS i FROM e0 GROUP BY 1) USING (id) GROUP BY type")
def a13_g5_entity_stats(spark, d):
    return G.stats(D.entities(spark, d), D.edges(spark, d))


@query("SELECT CAST(n AS VARCHAR) AS name, f AS frequency FROM (SELECT user_id AS n, count(*) AS f FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1 HAVING f >= 2) WHERE n NOT IN (SELECT s_suppkey FROM supplier)")
def a15_a16_seed_frequency(spark, d):
    n = D.table(spark, d, "events").filter("event_type in ('click', 'purchase')").groupBy("user_id").agg(F.count(F.lit(1)).alias("frequency")).filter("frequency >= 2")
    known = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return n.join(known, "user_id", "left_anti").select(F.col("user_id").cast("string").alias("name"), "frequency")


@query(f"WITH {EDGES}, {NODES}, x AS (SELECT 'no_outgoing' AS category, 'low' AS risk, id FROM n0 WHERE id NOT IN (SELECT source FROM e0) UNION ALL SELECT 'zero_reference', 'medium', id FROM n0 WHERE id NOT IN (SELECT target FROM e0)) SELECT *, row_number() OVER (ORDER BY CASE risk WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, category, id) AS place FROM x")
def g11_j17_review_queue(spark, d):
    n, e = D.entities(spark, d), D.edges(spark, d)
    return G.issues(("no_outgoing", "low", n.join(e.select(F.col("source").alias("id")), "id", "left_anti")), ("zero_reference", "medium", n.join(e.select(F.col("target").alias("id")), "id", "left_anti")))


# evaluation and diagnostics -------------------------------------------------------------------------------------------
@query("SELECT count(*) AS n, round(avg(value), 4) AS mean, quantile_disc(value, 0.95) AS p95, count(*) FILTER (value > 100) AS n_slow, count(*) FILTER (event_type = 'error') AS n_error FROM events")
def a18_t9_search_diagnostics(spark, d):
    return D.table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.count_if(F.col("value") > 100).alias("n_slow"), F.count_if(F.col("event_type") == "error").alias("n_error"))


QREL = "q AS (SELECT source || ' ' || lang AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"
RUN = "r0 AS (SELECT source || ' ' || lang AS query_id, doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents)"


@query(f"""WITH {QREL}, {RUN}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM r0 QUALIFY r <= 5),
h AS (SELECT query_id, min(r) AS f, count(*) AS hits, sum(1 / log2(r + 1)) AS dcg FROM t SEMI JOIN q USING (query_id, doc_id) GROUP BY 1),
z AS (SELECT query_id, count(*) AS size FROM t GROUP BY 1), n AS (SELECT query_id, count(DISTINCT doc_id) AS n_relevant FROM q GROUP BY 1)
SELECT query_id, n_relevant, round(coalesce(1 / f, 0), 4) AS mrr, round(coalesce(hits / n_relevant, 0), 4) AS recall, round(coalesce(hits / size, 0), 4) AS prec,
round(coalesce(dcg / list_sum(list_transform(range(1, CAST(least(n_relevant, 5) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 0), 4) AS ndcg FROM n LEFT JOIN h USING (query_id) LEFT JOIN z USING (query_id)""")
def a19_a20_j18_ir_metrics(spark, d):
    docs = D.table(spark, d, "documents").select(F.concat_ws(" ", "source", "lang").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    good = D.table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return E.per_query(docs, docs.join(good, "doc_id").select("query_id", "doc_id"))


@query("SELECT coalesce(a.k, b.k) AS query_id, CASE WHEN a.p IS NULL THEN 'new_in_candidate' WHEN b.p IS NULL THEN 'missing_from_candidate' WHEN a.p AND b.p THEN 'still_passing' WHEN NOT a.p AND b.p THEN 'fixed' WHEN a.p THEN 'regressed' ELSE 'still_failing' END AS status FROM (SELECT doc_id AS k, quality = 1 AS p FROM labels) a FULL JOIN (SELECT doc_id AS k, n_chars >= 500 AS p FROM documents) b ON a.k = b.k")
def a31_j20_run_compare(spark, d):
    base = D.table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("passed"))
    return E.compare(base, D.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), (F.col("n_chars") >= 500).alias("passed")))


@query("SELECT lang AS category, count(*) AS n, count(*) FILTER (quality = 1) AS n_pass, round(avg(CAST(quality AS DOUBLE)), 4) AS pass_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a22_a23_a33_rates_by_category(spark, d):
    j = D.table(spark, d, "labels").join(D.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_pass"), F.round(F.avg("quality"), 4).alias("pass_rate"))


# functions ------------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {TITLE} AS title, {ABSTRACT} AS abstract FROM documents")
def f8_f10_title_abstract(spark, d):
    return D.document_entries(spark, d).select("doc_id", "title", "abstract")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS BIGINT) AS n_words FROM documents")
def f22_word_count(spark, d):
    return D.table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("SELECT event_id, sha256(concat_ws(chr(0), 'v1', CAST(event_id AS VARCHAR), event_type, props)) AS fingerprint FROM events")
def a29_f20_fingerprint(spark, d):
    return D.table(spark, d, "events").select("event_id", T.fingerprint("v1", F.col("event_id"), F.col("event_type"), F.col("props")).alias("fingerprint"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f19_json_field(spark, d):
    return D.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def a11_trajectory_metric(spark, d):
    return D.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query(r"SELECT doc_id, CAST(len(x) AS BIGINT) AS n_numbers, x[1] AS first_number FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+\.[0-9]+') AS x FROM documents) WHERE len(x) > 0")
def f21_numbers_in_text(spark, d):
    t = D.table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), 0).alias("x"))
    return t.filter(F.size("x") > 0).select("doc_id", F.size("x").cast("long").alias("n_numbers"), F.get("x", F.lit(0)).alias("first_number"))


@query("SELECT a.p_partkey AS id1, b.p_partkey AS id2, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name), 1), 4) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def f4_levenshtein_similarity(spark, d):
    p = D.table(spark, d, "part").select("p_partkey", "p_name")
    a, b = p.toDF("id1", "n1"), p.toDF("id2", "n2")
    return a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", F.round(T.similarity(F.col("n1"), F.col("n2")), 4).alias("similarity"))


@query(f"SELECT strftime(m, '%Y-%m') AS month, CAST(count(doc_id) AS BIGINT) AS n FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1995-12-01', INTERVAL 1 MONTH)) AS m) LEFT JOIN {OR} ON date_trunc('month', date) = m GROUP BY 1")
def f12_month_series(spark, d):
    m = spark.range(1).select(F.explode(F.expr("sequence(date'1995-01-01', date'1995-12-01', interval 1 month)")).alias("m"))
    o = D.order_entries(spark, d).filter(F.col("date").between("1995-01-01", "1995-12-31")).select(F.trunc("date", "MM").alias("m"), "doc_id")
    return F.broadcast(m).join(o.groupBy("m").agg(F.count(F.lit(1)).alias("n")), "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# data quality and ingestion -------------------------------------------------------------------------------------------
@query(r"SELECT doc_id, starts_with(text, chr(65279)) AS has_bom, regexp_matches(text, 'Ã©|Ã¨|â€|ï¿½') AS mojibake, regexp_matches(text, '(/home/|/Users/|[A-Z]:\\)') AS local_path, regexp_matches(text, '(ghp_[A-Za-z0-9]{20}|sk-[A-Za-z0-9]{20})') AS key_like FROM documents")
def q8_q9_q10_text_checks(spark, d):
    return Q.text_flags(D.table(spark, d, "documents"))


OLD = "(SELECT o_orderkey AS doc_id, md5(o_orderstatus) AS hash FROM orders)"
NEW = "(SELECT l_orderkey AS doc_id, md5(CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'P' ELSE min(l_linestatus) END) AS hash FROM lineitem GROUP BY 1)"


def _versions(spark, d):
    """Orders' states as recorded, and as their lines have them."""
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    lines = dealt(D.table(spark, d, "lineitem").select("l_orderkey", "l_linestatus"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.md5(F.when(low != high, "P").otherwise(low)).alias("hash"))
    return dealt(D.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.md5("o_orderstatus").alias("hash")), lines


@query(f"SELECT doc_id, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'updated' ELSE 'same' END AS change FROM {OLD} a FULL JOIN {NEW} b USING (doc_id)")
def u4_k3_change_set(spark, d):
    return C.change_set(*_versions(spark, d))


@query(f"SELECT doc_id, CASE WHEN b.hash IS NULL THEN 'scope_missing' WHEN a.hash IS NULL THEN 'removed_scope' WHEN a.hash <> b.hash THEN 'source_hash_mismatch' ELSE 'fresh' END AS reason FROM {OLD} a FULL JOIN {NEW} b USING (doc_id)")
def q14_q5_freshness(spark, d):
    return C.freshness(*_versions(spark, d))


@query(f"SELECT doc_id FROM {NEW} a ANTI JOIN {OLD} b ON a.doc_id = b.doc_id AND a.hash = b.hash")
def k7_u7_backup_diff(spark, d):
    old, new = _versions(spark, d)
    return new.join(old, ["doc_id", "hash"], "left_anti").select("doc_id")


@query(f"SELECT doc_id, 'missing' AS problem FROM {NEW} a ANTI JOIN {OLD} b USING (doc_id) UNION ALL SELECT doc_id, 'orphan' FROM {OLD} b ANTI JOIN {NEW} a USING (doc_id)")
def j13_q2_index_consistency(spark, d):
    old, new = _versions(spark, d)
    return new.join(old, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("problem")).unionByName(old.join(new, "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("problem")))


@query(f"""WITH p0 AS (SELECT date, doc_id // 1024 AS page, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS h FROM {EV} GROUP BY 1, 2), p1 AS (SELECT date, page // 1024 AS page, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY p0.page)) AS h FROM p0 GROUP BY date, p0.page // 1024)
SELECT CAST(date AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, ',' ORDER BY page)) AS members FROM p1 GROUP BY date""")
def a28_day_grouping(spark, d):
    """A day's entries and a digest of them: pages of 1,024 ids first, then pages of pages, so that no list holds a whole day."""
    e = D.event_entries(spark, d).select(F.col("date").cast("string").alias("day"), "doc_id")
    return T.paged_digest(e, ["day"], "doc_id").withColumnRenamed("digest", "members")


@query("SELECT md5(text) AS idempotency_key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def t3_t4_idempotent_import(spark, d):
    return D.table(spark, d, "documents").groupBy(F.md5("text").alias("idempotency_key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t7_tumbling_windows(spark, d):
    return I.windowed_counts(D.table(spark, d, "events"))


@query(f"SELECT count(*) AS n, min(doc_id) AS first_id FROM {EV} WHERE date BETWEEN DATE '2024-01-30' - 6 AND DATE '2024-01-30'")
def t6_past_days(spark, d):
    return D.event_entries(spark, d).filter(F.col("date").between(F.date_sub(F.lit("2024-01-30").cast("date"), 6), F.lit("2024-01-30").cast("date"))).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def _paths_sql(relations: str, hops: int, most: int) -> str:
    return f"""WITH RECURSIVE {EDGES}, b AS (SELECT source AS at, target AS to, relation, source, target FROM e0 WHERE {relations} UNION SELECT target, source, relation, source, target FROM e0 WHERE {relations}),
w AS (SELECT 'nation-3' AS id, 0::BIGINT AS hops, []::VARCHAR[] AS rs, []::VARCHAR[] AS ss, []::VARCHAR[] AS ts UNION SELECT b.to, hops + 1, list_append(rs, relation), list_append(ss, source), list_append(ts, target) FROM w JOIN b ON b.at = w.id WHERE hops < {hops} AND b.to <> 'nation-3'),
k AS (SELECT id, min({{'h': hops, 'r': rs, 's': ss, 't': ts}}) AS p FROM w WHERE id <> 'nation-3' GROUP BY id)
SELECT id, p.h AS hops, array_to_string(p.r, '>') AS relations, array_to_string(p.s, '>') AS sources, array_to_string(p.t, '>') AS targets, row_number() OVER (ORDER BY p.h, p.r, p.s, p.t, id) AS place FROM k ORDER BY place LIMIT {most}"""


def _shown(rows):
    return rows.select("id", "hops", *(F.array_join(c, ">").alias(c) for c in ("relations", "sources", "targets")), "place")


@query(_paths_sql("true", 3, 50))
def j7_g2_nearest_by_path(spark, d):
    return _shown(G.paths(D.edges(spark, d), "nation-3", 3))


@query(_paths_sql("relation = 'member_of'", 2, 5))
def j7_g2_nearest_of_a_relation(spark, d):
    return _shown(G.paths(D.edges(spark, d), "nation-3", 2, ["member_of"], 5))


@query(f"WITH s AS (SELECT user_id, max(date) AS last FROM {EV} GROUP BY 1), z AS (SELECT max(date) AS now FROM {EV}), m AS (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM {EV}) SELECT 'silence' AS event, CAST(user_id AS VARCHAR) AS key, CAST(now - last AS BIGINT) AS days FROM s, z WHERE now - last >= 7 UNION ALL SELECT 'audit_due', 'all', CAST(now - DATE '2023-12-15' AS BIGINT) FROM z WHERE now - DATE '2023-12-15' >= 30 UNION ALL SELECT 'monthly_review', month, 0 FROM m UNION ALL SELECT 'stale_index', 'all', CAST(now - DATE '2024-01-15' AS BIGINT) FROM z WHERE now > DATE '2024-01-15' UNION ALL SELECT 'schema', '2', 0 FROM z")
def t5_w4_events_due(spark, d):
    return I.events_due(D.event_entries(spark, d), "user_id", audited="2023-12-15", indexed="2024-01-15", reviewed=[], version=2, versions=spark.createDataFrame([(1,), (2,)], "version int"))


# further queries add themselves to the same tables
from . import registry_entities, registry_index, registry_more, registry_plans, registry_scale, registry_search, registry_stores, registry_upkeep  # noqa: E402,F401
