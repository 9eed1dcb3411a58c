"""Queries of the driver-side plans on stated phrases, of scalar functions, sources and sinks, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import adapters as D
from . import search_plan as P
from . import time_grammar as G
from .registry import case, query

ON = date(2026, 3, 18)
#: Phrases and what they mean on 18 March 2026 (a Wednesday), worked out by hand.
TIMES = [
    ("2026年3月5日的日志", "2026-03-05", "2026-03-05"), ("2025-12-31", "2025-12-31", "2025-12-31"), ("2024年2月", "2024-02-01", "2024-02-29"), ("x 2025-11 y", "2025-11-01", "2025-11-30"),
    ("今年一月", "2026-01-01", "2026-01-31"), ("去年十二月", "2025-12-01", "2025-12-31"), ("去年的冬天", "2024-12-01", "2025-02-28"), ("春天", "2026-03-01", "2026-05-31"), ("冬天", "2025-12-01", "2026-02-28"),
    ("三月下旬到四月", "2026-03-21", "2026-04-30"), ("三月初", "2026-03-01", "2026-03-10"), ("三月中旬", "2026-03-11", "2026-03-20"), ("二月底", "2026-02-21", "2026-02-28"), ("12月底", "2026-12-21", "2026-12-31"),
    ("上半年", "2026-01-01", "2026-06-30"), ("上周", "2026-03-09", "2026-03-15"), ("本周", "2026-03-16", "2026-03-18"), ("这个月", "2026-03-01", "2026-03-31"), ("三月十五号", "2026-03-15", "2026-03-15"), ("5月20日", "2025-05-20", "2025-05-20"),
    ("二月份", "2026-02-01", "2026-02-28"), ("过去7天", "2026-03-11", "2026-03-18"), ("过去2周", "2026-03-04", "2026-03-18"), ("过去1个月", "2026-02-18", "2026-03-18"), ("过去一年", "2025-03-18", "2026-03-18"), ("最近一周", "2026-03-11", "2026-03-18"),
    ("上个月", "2026-02-01", "2026-02-28"), ("下月", "2026-04-01", "2026-04-30"), ("去年这个时候", "2025-03-03", "2025-04-02"), ("去年", "2025-01-01", "2025-12-31"), ("今年", "2026-01-01", "2026-03-18"), ("明年", "2027-01-01", "2027-12-31"), ("最近", "2026-02-16", "2026-03-18"),
    ("11月", "2025-11-01", "2025-11-30"), ("3天前", "2026-03-15", "2026-03-15"), ("2周前", "2026-03-04", "2026-03-04"), ("大半个月", "2026-02-25", "2026-03-18"), ("半个月", "2026-03-03", "2026-03-18"), ("半年", "2025-09-18", "2026-03-18"), ("两周", "2026-03-04", "2026-03-18"), ("ID2025-11-30x", None, None), ("没有时间", None, None),
]
_v = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_v, r)) + ")" for r in rows) + ")"


@case(f"SELECT * FROM {_values(TIMES)} t(phrase, since, until)")
def f11_f0_time_ranges(spark, d):
    found = [(p, *((str(g[0]), str(g[1])) if (g := G.find(p, ON)) else (None, None))) for p, _, _ in TIMES]
    return spark.createDataFrame(found, "phrase string, since string, until string")


READ = [
    ("how many late nights 过去7天", "count", "aggregation_requires_agent_judgement,time_range_interpretation", "retrieval_boundary,refinement_suggestion,time_range_parsed"),
    ("walks by the river", "recall", "", ""), ("a", "recall", "query_too_broad", ""), ("compare 2025-11", "compare", "aggregation_requires_agent_judgement", "retrieval_boundary,refinement_suggestion"), ("上个月 跑步", "recall", "time_range_interpretation", "time_range_parsed"),
]


@case(f"SELECT * FROM {_values(READ)} t(phrase, intent, ambiguities, hints)")
def r21_r22_r28_query_reading(spark, d):
    rows = []
    for q, *_ in READ:
        plan = P.build(q, ON)
        rows.append((q, P.intent(q), ",".join(k for k, _ in P.ambiguities(plan)), ",".join(k for k, _ in P.hints(plan))))
    return spark.createDataFrame(rows, "phrase string, intent string, ambiguities string, hints string")


_KNOWN = {"ann": ["Ann", "Annie", "小安"], "bob": ["Bob"], "annb": ["Ann Bob"]}
WIDER = [("dinner with Ann", 'dinner AND with AND ("Ann" OR "Annie" OR "小安")', "ann"), ("Ann Bob met bob", '("Ann Bob") AND met AND ("Bob")', "annb,bob"), ("和小安散步", '和 AND ("Ann" OR "Annie" OR "小安") AND 散步', "ann"), ("annual bobsled", "annual AND bobsled", "")]


@case(f"SELECT * FROM {_values(WIDER)} t(phrase, expanded, entities)")
def r19_r20_query_expansion(spark, d):
    return spark.createDataFrame([(q, e, ",".join(found)) for q, _, _ in WIDER for e, found in [P.expanded(q, _KNOWN)]], "phrase string, expanded string, entities string")


SPELT = [("jurnal of running", "journal of running"), ("runing fast", "running fast"), ("journal", "journal"), ("xyz abc", "xyz abc")]


@case(f"SELECT * FROM {_values(SPELT)} t(phrase, respelt)")
def r21_f4_typos(spark, d):
    return spark.createDataFrame([(q, P.respelt(q, ["journal", "running"])) for q, _ in SPELT], "phrase string, respelt string")


ASKED = [("how many days in the past 7 days", "day", "2026-03-12", "2026-03-18", "journal_count"), ("多少天 after 22:30 过去30天", "day", "2026-02-17", "2026-03-18", "entry_time_after"), ("how often this month by week", "week", "2026-03-01", "2026-03-18", "journal_count"), ("walks", None, None, None, None)]


@case(f"SELECT * FROM {_values(ASKED)} t(phrase, unit, since, until, predicate)")
def r23_t6_aggregate_intent(spark, d):
    rows = []
    for q, *_ in ASKED:
        a = P.aggregate_intent(q, ON)
        rows.append((q, a["unit"], str(a["range"].since), str(a["range"].until), a["predicate"]["name"]) if a else (q, None, None, None, None))
    return spark.createDataFrame(rows, "phrase string, unit string, since string, until string, predicate string")


QUERIES_AS_GIVEN = [("  《読書》 ", "読書"), ("《読書》。", "読書》"), ("ＡＢＣ　１２３！", "ABC 123"), ("“two   words”", "two words"), ("“two   words”…", "two words”"), ("!?", ""), (None, ""), ("plain", "plain")]


@case(f"SELECT * FROM {_values([(k, b) for k, (_, b) in enumerate(QUERIES_AS_GIVEN)])} t(id, normalized)")
def f1_normalized_queries(spark, d):
    return spark.createDataFrame([(k, a) for k, (a, _) in enumerate(QUERIES_AS_GIVEN)], "id int, q string").select("id", T.normalized(F.col("q")).alias("normalized"))


@query("SELECT p_partkey, round(1 / (1 + 0.1::DOUBLE * (p_size - 1) * (p_size - 1)), 6) AS weight FROM part")
def f16_decay(spark, d):
    return D.table(spark, d, "part").select("p_partkey", F.round(T.decayed(F.col("p_size")), 6).alias("weight"))


@query("SELECT p_partkey, round((p_partkey % 90 + (p_size / 60) + (p_partkey % 60) / 3600) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END, 6) AS degrees FROM part")
def f17_degrees(spark, d):
    k = F.col("p_partkey")
    return D.table(spark, d, "part").select("p_partkey", F.round(T.degrees(k % 90, F.col("p_size"), k % 60, F.when(k % 2 == 0, "s").otherwise("N")), 6).alias("degrees"))


@query(r"""SELECT page_id, regexp_replace(trim(url), '[\\/:*?"<>|\s]+', '_', 'g') AS name FROM pages WHERE url IS NOT NULL""")
def f7_file_names(spark, d):
    return D.table(spark, d, "pages").filter("url is not null").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minutes FROM events")
def f14_minutes_of_day(spark, d):
    return D.table(spark, d, "events").select("event_id", T.minutes_of_day(F.date_format("ts", "HH:mm:ss")).alias("minutes"))


LISTS = [('["a", "b"]', "a|b"), ("a, b ,c", "a|b|c"), ('["é"]', "é")]


@case(f"SELECT * FROM {_values(LISTS)} t(given, items)")
def f18_f19_lists(spark, d):
    return spark.createDataFrame([(a,) for a, _ in LISTS], "given string").select("given", F.array_join(F.array_distinct(T.json_list(F.col("given"))), "|").alias("items"))


WORDS = [("日本語 text 2 words", 6), ("plain words here", 3), ("한국 ok", 3), ("", 0)]


@case(f"SELECT t, CAST(n AS BIGINT) AS n FROM {_values(WORDS)} t(t, n)")
def f22_word_count_cjk(spark, d):
    return spark.createDataFrame([(a,) for a, _ in WORDS], "t string").select("t", T.word_count(F.col("t")).alias("n"))
