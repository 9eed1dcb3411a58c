"""Edge cases by hand."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from almanack.functions import text as T
from almanack.operators import aggregate as A
from almanack.operators import changes as C
from almanack.operators import evaluate as E
from almanack.operators import graph as G
from almanack.operators import search as S
from almanack.plans import search_plan as P
from almanack.sources import frontmatter as M
from almanack.streaming import incremental as I


def test_minutes_of_day(spark):
    given = [("07:05", 425), ("23:59:59", 1439), ("1439", 1439), ("82800", 1380), ("noon", None), ("25:00", None), (None, None)]
    df = spark.createDataFrame(given, "v string, want int").withColumn("got", T.minutes_of_day(F.col("v")))
    assert [r.got for r in df.collect()] == [w for _, w in given]


def test_three_valued_roles_and_bounds(spark):
    e = spark.createDataFrame([(1, date(2024, 1, 1), 600), (2, date(2024, 1, 1), None), (3, date(2024, 1, 3), None)], "doc_id long, date date, time_minutes int")
    r = A.summary(e, F.col("time_minutes") >= 500, "day").first()
    assert (r.n, r.n_min, r.n_max, r.denominator) == (1, 1, 2, 3)
    roles = {x.role for x in A.roles(e, F.col("time_minutes") >= 500).collect()}
    assert roles == {"matched", "unknown"}


def test_empty_denominator(spark):
    e = spark.createDataFrame([], "doc_id long, date date, time_minutes int")
    assert A.summary(e, F.lit(True), "day").first().denominator == 0


def test_iso_week_at_year_end(spark):
    assert spark.range(1).select(T.iso_week(F.lit("2024-12-30").cast("date"))).first()[0] == "2025-W01"


def test_tukey_needs_eight(spark):
    few = spark.createDataFrame([(i, float(i)) for i in range(1, 8)], "doc_id long, score double")
    many = spark.createDataFrame([(i, s) for i, s in enumerate([1.0, 60.0, 61.0, 62.0, 63.0, 64.0, 65.0, 66.0, 67.0])], "doc_id long, score double")
    assert S.tukey(few).first().fence == 25.0
    assert S.tukey(many).first().fence == 61.0 - 1.5 * (65.0 - 61.0)


def test_neighbours_in_a_cycle(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "s", "d")], "source string, relation string, target string")
    assert {(r.id, r.hops) for r in G.neighbours(e, "a", 3).collect()} == {("b", 1), ("c", 1), ("d", 2)}


def test_near_names_are_complete(spark):
    names = ["anna", "ana", "annas", "bnna", "anan", "otto"]
    n = spark.createDataFrame(list(enumerate(names)), "id long, name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if False else _step(row, i, x, b)
        return row[-1]

    def _step(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if distance(names[i], names[j]) <= 1}
    assert {(r.id1, r.id2) for r in G.near_names(n).collect()} == want


def test_ir_metrics(spark):
    run = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (2, 12, 1.0)], "query_id long, doc_id long, score double")
    qrels = spark.createDataFrame([(1, 11), (3, 9)], "query_id long, doc_id long")
    got = {r.query_id: r for r in E.per_query(run, qrels).collect()}
    assert got[1].mrr == 0.5 and got[1].recall == 1.0 and got[1].ndcg == 0.6309 and got[3].mrr == 0


def test_time_ranges():
    as_of = date(2024, 3, 31)
    assert P.time_range("notes of 2024-02", as_of).until == date(2024, 2, 29)
    assert P.time_range("past 7 days", as_of).since == date(2024, 3, 24)
    assert P.time_range("上个月", as_of).since == date(2024, 2, 1)
    assert P.time_range("2024-02-31", as_of) is None
    assert P.aggregate_intent("how many days in the past 7 days after 22:30", as_of)["range"].since == date(2024, 3, 25)
    assert P.build("the cat and the dog", as_of).terms == ("cat", "dog")


def test_frontmatter(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\ndate: 2024-01-02\ntopic: work\ntags: [x, y]\nweight_kg: 70\n---\nbody", encoding="utf-8")
    (tmp_path / "b.md").write_text("# Head\ntext", encoding="utf-8")
    got = {r.title: r for r in M.read_entries(spark, f"{tmp_path}/*.md").collect()}
    assert got["T"].topic == ["work"] and got["T"].tags == ["x", "y"] and got["T"].extra["weight_kg"] == "70" and got["T"].year == 2024
    assert got["Head"].date is None
    M.write_entries(M.read_entries(spark, f"{tmp_path}/*.md"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("year = 2024 and month = 1").count() == 1


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "doc_id long, version long, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, 1, "a"), (2, 1, "b")])
    args = spark, f"{tmp_path}/in", schema, f"{tmp_path}/table", f"{tmp_path}/cp"
    I.upsert_stream(*args)
    put([(1, 2, "c"), (3, 1, "d")])
    I.upsert_stream(*args)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/table/gen=1").collect()) == ["b", "c", "d"]


def test_sessions(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in I.sessions(e).collect()) == [1, 2]


def test_change_set_and_run_comparison_name_every_case(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, hash string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "doc_id long, hash string")
    assert {r.doc_id: r.change for r in C.change_set(old, new).collect()} == {1: "removed", 2: "same", 3: "updated", 4: "added"}
    assert {r.doc_id: r.reason for r in C.freshness(old, new).collect()} == {1: "scope_missing", 2: "fresh", 3: "source_hash_mismatch", 4: "removed_scope"}
    schema = "query_id long, passed boolean"
    a = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False), (5, True)], schema)
    b = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False), (6, True)], schema)
    want = {1: "still_passing", 2: "regressed", 3: "fixed", 4: "still_failing", 5: "missing_from_candidate", 6: "new_in_candidate"}
    assert {r.query_id: r.status for r in E.compare(a, b).collect()} == want


def test_related_without_shared_people(spark):
    r = random.Random(4)
    given = [(k, date.fromordinal(730000 + r.choice((r.randint(0, 8), r.randint(0, 300)))), *(r.choice((None, "a", "b", "c")) for _ in range(3))) for k in range(150)]
    points = {"person": 40, "topic": 20, "tags": 15}

    def want(e):
        out = []
        for o in given:
            dist = abs((e[1] - o[1]).days)
            score = sum(p for p, x, y in zip(points.values(), e[2:], o[2:], strict=True) if x and x == y) + (max(1, 10 - min(dist, 9)) if dist <= 30 else 0)
            if o[0] != e[0] and score:
                out.append((-score, dist, -o[0]))
        return [(e[0], -i, -s, n) for n, (s, _, i) in enumerate(sorted(out)[:5], 1)]

    got = G.related(spark.createDataFrame(given, "doc_id long, date date, person string, topic string, tags string"), points).collect()
    assert sorted(map(tuple, got)) == sorted(x for e in given for x in want(e))


def test_noise_rules_in_order(spark):
    given = {
        None: "empty_query", "": "empty_query", " \t　\x1c": "empty_query", "!!!": "pure_symbols", "。 ，-": "pure_symbols", "12345": "pure_digits", " ٣٤٥²": "pure_digits",
        "aaaa": "repeated_char", "💡💡": "repeated_char", "菜菜": "repeated_char", "a, b": "too_short", "菜!": "too_short", "猫 狗": "too_short", "xyz123456789": "alphanumeric_noise", "ab 12 34": "alphanumeric_noise", "a-1-b-2": "no_dictionary_words", "éé éé": "no_dictionary_words",
        "不存在的日志标题": "negation_intent", "菜谱 不相关": "negation_intent", "菜谱推荐": "ood_topic", "my 区块链 notes": "ood_topic", "open almanxxx": "typo_near_noise", "OPN almanac": "typo_near_noise", "open almanack": "none", "今天的日志": "none", "日志 12345678": "none", "apache license": "none",
    }
    df = spark.createDataFrame([(k, v) for k, v in given.items()], "q string, want string").withColumn("got", T.noise(F.col("q")))
    assert [r for r in df.collect() if r.want != r.got] == []


def test_graph_file_is_validated(spark):
    from almanack.sources import frontmatter as M

    if M.yaml is None:
        pytest.skip("needs a YAML library")
    good = "entities:\n- {id: a, type: person, primary_name: Ann, aliases: [Annie], relationships: [{target: b, relation: friend_of}]}\n- {id: b, primary_name: Bob}\n"
    rows = {r.id: r for r in M.read_graph(spark, good).collect()}
    assert rows["a"].relationships[0].target == "b" and rows["b"].aliases == []
    with pytest.raises(M.BadGraph, match="id is used twice"):
        M.read_graph(spark, good + "- {id: a, primary_name: Other}\n")
    with pytest.raises(M.BadGraph, match="name annie is that of a"):
        M.read_graph(spark, good + "- {id: c, primary_name: annie}\n")
    with pytest.raises(M.BadGraph, match="target z is unknown"):
        M.read_graph(spark, good + "- {id: c, primary_name: Cy, relationships: [{target: z, relation: x}]}\n")


def test_heads_end_at_delimiter_lines():
    from almanack.sources import frontmatter as M

    assert M.parse("---\ntitle: 'a --- b'\n---\nbody\n--- more") == ({"title": "a --- b"}, "body\n--- more")
    assert M.parse("---\ntitle: x\nno end") == ({}, "---\ntitle: x\nno end") and M.parse("plain") == ({}, "plain")
    head, body = M.parse("---\ntitle: a: b: c\ntags: [x, y]\n---\n\ntext")
    assert head["tags"] == ["x", "y"] and head["title"] and body == "text"
