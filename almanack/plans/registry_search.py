"""Queries of tiered ranking and search presentation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..sources import adapters as D
from ..sources.store import written
from .registry import ABSTRACT, TITLE, query

ENT = f"(SELECT doc_id, {TITLE} AS title, {ABSTRACT} AS abstract, text AS body, CASE WHEN n_chars >= 1000 THEN [lang] ELSE [] END AS tags, source AS location, CASE WHEN lang IN ('en', 'fr') THEN source END AS topic, DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS date FROM documents)"


def entries(spark, d):
    """Documents as dated entries with tags, place and, for two languages, a topic."""
    e = D.document_entries(spark, d).select("doc_id", "title", "abstract", "body", F.col("tag").alias("lang"), F.col("project").alias("location"))
    n = F.length("body")
    return e.withColumns({
        "tags": F.when(n >= 1000, F.array("lang")).otherwise(F.array().cast("array<string>")), "people": F.array().cast("array<string>"),
        "topic": F.when(F.col("lang").isin("en", "fr"), F.col("location")), "date": F.expr("date_add(date'2024-01-01', cast(doc_id % 366 as int))"),
    })


def _word(c: str, t: str) -> str:
    return f"coalesce(regexp_matches(lower({c}), '(^|[^a-z0-9]){t}([^a-z0-9]|$)'), false)"


ASKED, TERM, TOPIC, SINCE, UNTIL = "the and", "apache", "src1", "2024-03-01", "2024-06-30"
_TOK = ASKED.split()
_TWO = " OR ".join(_word(c, t) for t in _TOK for c in ("title", "abstract", "location", "array_to_string(tags, ' ')"))
_POINTS = " + ".join([*(f"CASE WHEN {_word(c, t)} THEN {v} ELSE 0 END" for t in _TOK for c, v in (("title", 8), ("abstract", 4), ("array_to_string(tags, ' ')", 3))),
                      f"CASE WHEN {' OR '.join(_word('location', t) for t in _TOK)} THEN 15 ELSE 0 END",
                      f"CASE WHEN starts_with(lower(title), '{ASKED}') THEN 10 WHEN contains(lower(title), '{ASKED}') THEN 3 ELSE 0 END",
                      f"CASE WHEN contains(lower(title || ' ' || abstract), '{TERM}') THEN 6 ELSE 0 END"])
CONTENT = f"""c0 AS (SELECT *, coalesce(contains(lower(title), '{ASKED}'), false) AS title_match, len(list_filter(string_split(body, chr(10)), lambda x: contains(lower(x), '{ASKED}'))) AS n_lines FROM {ENT}),
c1 AS (SELECT *, least(80, CASE WHEN title_match THEN 40 ELSE 0 END + 10 * least(n_lines, 3)) AS relevance FROM c0)"""
SCORED = f"""{CONTENT}, t1 AS (SELECT *, ({_TWO}) AS two, {_POINTS} AS points FROM c1),
t2 AS (SELECT *, CASE WHEN relevance >= 15 THEN 3 WHEN two THEN 2 WHEN topic = '{TOPIC}' THEN 1 END AS tier FROM t1),
t3 AS (SELECT *, CASE tier WHEN 3 THEN relevance + CASE WHEN title_match THEN 10 ELSE 0 END + CASE WHEN two THEN points ELSE 0 END WHEN 2 THEN 30 + points ELSE 10 END::DOUBLE AS base FROM t2 WHERE tier IS NOT NULL),
s0 AS (SELECT *, round((base * CASE WHEN topic = '{TOPIC}' THEN 1.1::DOUBLE ELSE 1 END + CASE WHEN topic = '{TOPIC}' AND date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' THEN 50 ELSE 0 END)
  * CASE WHEN topic IS NOT NULL AND len(tags) > 0 THEN 1.08::DOUBLE WHEN topic IS NOT NULL OR len(tags) > 0 THEN 1.04::DOUBLE ELSE 1 END, 4) AS score FROM t3)"""
FENCED = f"""{SCORED}, k0 AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM s0 WHERE score > 0),
f0 AS (SELECT max(n) AS n, max(score) FILTER (k = n // 4) AS q1, max(score) FILTER (k = 3 * n // 4) AS q3 FROM k0),
f1 AS (SELECT *, round(CASE WHEN n >= 8 AND q3 > q1 THEN greatest(25, q1 - 1.5::DOUBLE * (q3 - q1)) ELSE 25 END::DOUBLE, 4) AS fence FROM f0),
p0 AS (SELECT s0.* FROM s0, f1 WHERE (tier < 3 AND score >= 10) OR (tier = 3 AND score >= fence))"""
_LETTERS = [c for c in ASKED if c.strip() and c not in R.STOP_LETTERS]
_HELD = " + ".join(f"contains(lower(title), '{c}')::INT" for c in _LETTERS)
RANKED = f"""{FENCED}, p1 AS (SELECT *, row_number() OVER (ORDER BY score DESC, tier DESC, CASE WHEN instr(lower(title), '{ASKED}') > 0 THEN instr(lower(title), '{ASKED}') - 1 ELSE 9999 END, doc_id) AS search_rank,
  coalesce({_HELD} >= 0.6 * {len(_LETTERS)}, false) AS promoted, CASE WHEN tier = 3 THEN relevance ELSE 0 END AS hit FROM p0),
p2 AS (SELECT *, round(score * CASE WHEN promoted THEN 1.5::DOUBLE ELSE 1 END, 4) AS final_score FROM p1)"""


def _scored(spark, d):
    return R.scored(entries(spark, d), ASKED, [TERM], [TOPIC], SINCE, UNTIL, F.coalesce(F.col("topic") == TOPIC, F.lit(False)), True)


@query(f"WITH {CONTENT} SELECT doc_id, title_match, CAST(n_lines AS BIGINT) AS n_lines, CAST(relevance AS BIGINT) AS relevance FROM c1 WHERE relevance >= 15")
def r8_content_fallback(spark, d):
    return R.content(entries(spark, d), ASKED).filter(F.col("relevance") >= R.LEAST_CONTENT).select("doc_id", "title_match", F.col("n_lines").cast("long"), F.col("relevance").cast("long"))


@query(f"WITH {SCORED} SELECT doc_id, CAST(tier AS BIGINT) AS tier, score FROM s0")
def r9_r10_r12_tier_scores(spark, d):
    return _scored(spark, d).select("doc_id", "tier", "score")


@query(f"WITH {FENCED} SELECT CAST(s0.tier AS BIGINT) AS tier, count(*) AS n_found, count(p0.doc_id) AS n_passing, max(f1.fence) AS fence FROM s0 LEFT JOIN p0 USING (doc_id), f1 GROUP BY 1")
def r13_tier_thresholds(spark, d):
    s = written(_scored(spark, d).select("doc_id", "tier", "score"), "scored")
    kept = R.passing(s).groupBy("tier").agg(F.count(F.lit(1)).alias("k"))
    found = s.groupBy("tier").agg(F.count(F.lit(1)).alias("n_found")).join(kept, "tier", "left").crossJoin(F.broadcast(R.fence(s.select("score")).select("fence")))
    return found.select("tier", "n_found", F.coalesce("k", F.lit(0)).alias("n_passing"), "fence")


@query(f"""WITH {RANKED} SELECT doc_id, CAST(tier AS BIGINT) AS tier, score, search_rank, promoted, final_score, row_number() OVER (ORDER BY final_score DESC, search_rank) AS final_rank, CASE WHEN hit >= 50 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN promoted AND hit > 0 THEN '标题命中查询词（+1.5x 置顶）；关键词 FTS=' || printf('%.2f', hit::DOUBLE) WHEN promoted THEN '标题命中查询词（+1.5x 置顶）' WHEN hit > 0 THEN '关键词 FTS=' || printf('%.2f', hit::DOUBLE) ELSE '元数据匹配（弱信号）' END AS reason FROM p2""")
def w1_o1_o2_r14_r16_r17_ranked_results(spark, d):
    return R.ranked(_scored(spark, d), ASKED).select("doc_id", "tier", "score", "search_rank", "promoted", "final_score", "final_rank", "confidence", "reason")


_ASKS = ("the", "apache license", "zzz", "de la", "und")


def _ask_hits(spark, d):
    e = entries(spark, d).select("doc_id", "title", "body", "tags")
    each = [R.content(e, q).filter(F.col("relevance") >= R.LEAST_CONTENT).select(F.lit(q).alias("q"), F.col("relevance").alias("content_score"), R.confidence(F.col("relevance")).alias("confidence")) for q in _ASKS]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    asked = spark.createDataFrame([(q,) for q in _ASKS], "q string")
    return asked.join(out, "q", "left")


@query("WITH a AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in _ASKS) + f"]) AS q), h AS (SELECT q, least(80, CASE WHEN contains(lower(title), q) THEN 40 ELSE 0 END + 10 * least(len(list_filter(string_split(body, chr(10)), lambda x: contains(lower(x), q))), 3)) AS s FROM a, {ENT}) SELECT q, coalesce(max(s) FILTER (s >= 15), 0) < 50 AS no_confident_match FROM h GROUP BY q")
def r15_no_confident_match(spark, d):
    rows = _ask_hits(spark, d).withColumns({"content_score": F.coalesce("content_score", F.lit(0)), "confidence": F.coalesce("confidence", F.lit("none"))})
    return R.no_confident_match(rows, "q")


@query("SELECT item_id, CAST(CASE WHEN contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'the ') OR contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'ation') THEN 50 ELSE 25 END AS BIGINT) AS least FROM benchmark")
def r4_least_relevance(spark, d):
    return D.table(spark, d, "benchmark").select("item_id", R.least_relevance(F.col("text"), ["the ", "ation"]).cast("long").alias("least"))


_BARE = "lambda w: regexp_replace(lower(w), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"


@query(f"""WITH w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents WHERE contains(lower(text), 'apache') OR contains(lower(text), 'license')),
w1 AS (SELECT doc_id, ws, list_transform(ws, {_BARE}) AS bs FROM w0),
w2 AS (SELECT doc_id, ws, bs, greatest(0, least(unnest(range(0, len(bs))), len(bs) - 32)) AS a, unnest(bs) IN ('apache', 'license') AS hit FROM w1),
w3 AS (SELECT doc_id, ws, bs, a, CASE WHEN list_contains(bs[a + 1:a + 32], 'apache') THEN 1 ELSE 0 END + CASE WHEN list_contains(bs[a + 1:a + 32], 'license') THEN 1 ELSE 0 END AS n FROM w2 WHERE hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a) = 1)
SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || array_to_string(list_transform(ws[a + 1:a + 32], lambda w, i: CASE WHEN bs[a + i] IN ('apache', 'license') THEN '<mark>' || w || '</mark>' ELSE w END), ' ') || CASE WHEN a + 32 < len(ws) THEN '...' ELSE '' END AS snippet FROM w3""")
def r7_snippets(spark, d):
    t = D.table(spark, d, "documents").filter(F.lower("text").contains("apache") | F.lower("text").contains("license"))
    return t.select("doc_id", R.snippet(F.col("text"), ["apache", "license"]).alias("snippet")).filter("snippet is not null")


@query(f"WITH f AS (SELECT doc_id FROM {ENT} WHERE contains(lower(body), 'license')), m AS (SELECT doc_id FROM {ENT} WHERE date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' AND topic IN ('src1', 'src2')) SELECT doc_id, CASE WHEN f.doc_id IS NOT NULL THEN 'keyword' ELSE 'structured_metadata' END AS source FROM (SELECT doc_id FROM f UNION SELECT doc_id FROM m) u LEFT JOIN f USING (doc_id)")
def r18_structured_candidates(spark, d):
    e = entries(spark, d)
    return R.augmented(e.filter(F.lower("body").contains("license")), e, SINCE, UNTIL, ["src1", "src2"], ["license"])


@query(f"SELECT doc_id, CAST(date AS VARCHAR) AS day, row_number() OVER (ORDER BY date DESC, doc_id) AS place FROM {ENT} WHERE date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'")
def o3_dates_when_nothing_is_asked(spark, d):
    e = entries(spark, d).filter(F.col("date").between(SINCE, UNTIL)).select("doc_id", "date")
    return R.placed(e, "date", "place", "doc_id").select("doc_id", F.col("date").cast("string").alias("day"), "place")


@query(f"WITH {RANKED}, z AS (SELECT doc_id, row_number() OVER (ORDER BY final_score DESC, search_rank) AS final_rank, count(*) OVER () AS total FROM p2) SELECT doc_id, final_rank, total AS total_matches, total > 40 AS has_more FROM z WHERE final_rank BETWEEN 21 AND 40")
def o7_p19_page_of_results(spark, d):
    r = written(R.ranked(_scored(spark, d), ASKED).select("doc_id", "final_rank"), "ranked")
    total = r.agg(F.count(F.lit(1)).alias("total_matches"))
    return r.filter(F.col("final_rank").between(21, 40)).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total_matches") > 40)


@query(f"SELECT doc_id, 'Journals/' || strftime(date, '%Y/%m') || '/' || strftime(date, '%Y-%m-%d') || '_' || doc_id || '.md' AS rel_path, strftime(date, '%Y/%m') || '/' || strftime(date, '%Y-%m-%d') || '_' || doc_id || '.md' AS route_path, '/data/Journals/' || strftime(date, '%Y/%m') || '/' || strftime(date, '%Y-%m-%d') || '_' || doc_id || '.md' AS path FROM {ENT}")
def p18_path_fields(spark, d):
    route = F.concat(F.date_format("date", "yyyy/MM"), F.lit("/"), F.date_format("date", "yyyy-MM-dd"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    e = entries(spark, d).select("doc_id", route.alias("route_path")).withColumn("rel_path", F.concat(F.lit("Journals/"), "route_path"))
    return e.select("doc_id", "rel_path", "route_path", F.concat(F.lit("/data/"), "rel_path").alias("path"))


@query(f"SELECT doc_id FROM {ENT} WHERE year(date) = 2024 AND month(date) = 5 AND date >= DATE '2024-05-10' AND topic = 'src2'")
def p2_candidate_set(spark, d):
    e = entries(spark, d).select("doc_id", "date", "topic")
    month, topic, after = (x.select("doc_id") for x in (e.filter((F.year("date") == 2024) & (F.month("date") == 5)), e.filter("topic = 'src2'"), e.filter("date >= date'2024-05-10'")))
    return month.join(topic, "doc_id", "left_semi").join(after, "doc_id", "left_semi")


@query(f"SELECT doc_id FROM {ENT} WHERE {' OR '.join(_word(c, t) for t in ('apache', 'src3') for c in ('title', 'abstract', 'location'))} OR list_contains(tags, 'de')")
def p7_tokens_over_metadata(spark, d):
    e = entries(spark, d)
    return e.filter(R.metadata_hit(["apache", "src3"]) | F.array_contains("tags", "de")).select("doc_id")


@query(f"SELECT doc_id FROM {ENT} WHERE strftime(date, '%Y-%m') BETWEEN '2024-02' AND '2024-04'")
def p15_month_span(spark, d):
    return entries(spark, d).filter(F.date_format("date", "yyyy-MM").between("2024-02", "2024-04")).select("doc_id")
