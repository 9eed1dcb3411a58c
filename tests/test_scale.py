"""The persisted index, levelled runs and the operators for many rows, names and starts, against plain versions."""

import datetime as dt
import itertools
import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from almanack.operators import names, reach, segment, similar, sketches
from almanack.sources.hash_tree import HashTree, changes
from almanack.sources.runs import Runs
from almanack.sources.store import fresh
from almanack.sources.text_index import TextIndex, query_terms
from almanack.streaming import silence


# index ----------------------------------------------------------------------------------------------------------------
def plain_scores(rows, terms, weights=(1.0, 0.5)):
    words = {i: [segment._WORD.findall((t or "").lower()) for t in texts] for i, *texts in rows}
    tf = {i: [sum(w * own.count(t) for w, own in zip(weights, ws, strict=True)) for t in terms] for i, ws in words.items()}
    dl = {i: sum(map(len, ws)) for i, ws in words.items()}
    n, mean = len(rows), sum(dl.values()) / max(len(rows), 1)
    df = [sum(f[k] > 0 for f in tf.values()) for k in range(len(terms))]
    idf = [math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in df]
    out = [(round(sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl[i] / mean)) for w, f in zip(idf, fs, strict=True) if f), 4), i, sum(f > 0 for f in fs)) for i, fs in tf.items() if any(fs)]
    return sorted(out, key=lambda x: (-x[0], x[1]))


def some_rows(n, seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "rare", "Ärger", "x1"]
    say = lambda k: " ".join(r.choices(words, [9, 5, 3, 2, 0.2, 1, 1], k=k))
    return [(3 * i - 30, say(r.randint(0, 30)) if i % 11 else None, say(3)) for i in range(n)]


def test_index_equals_full_scores_and_skips_blocks(spark):
    rows = some_rows(300, 1) + [(5000 + i, "filler words", "none") for i in range(200)]
    schema = "doc_id long, body string, title string"
    df = spark.createDataFrame([*rows, (None, "alpha", "alpha")], schema)
    index = TextIndex(spark, fresh(spark, "index")).build(df, {"body": 1.0, "title": 0.5}, width=16)
    for terms, k in ((["rare"], 5), (["alpha", "rare"], 3), (["beta", "gamma", "delta"], 40), (["ärger", "missing"], 10), (["missing"], 4)):
        want = plain_scores(rows, terms)
        got = [(r.score, r.doc_id, r.n_terms) for r in index.search(terms, k).collect()]
        assert got == want[:k]
        both = [x for x in want if x[2] == len(terms)]
        assert [(r.score, r.doc_id) for r in index.search(terms, k, all_terms=True).collect()] == [x[:2] for x in both][:k]
        either = both if len(both) >= 3 else want
        assert [r.doc_id for r in index.and_then_or(terms, k).collect()] == [x[1] for x in either][:k]
    reads = index.reads(["rare", "alpha"], 2)
    assert 0 < reads["read_blocks"] < reads["all_blocks"] and reads["read_postings"] < reads["all_postings"]
    assert index.search([], 5).collect() == []


def test_index_updates_by_ranges(spark):
    schema = "doc_id long, body string, title string"
    rows = {i: (b, t) for i, b, t in some_rows(120, 2)}
    frame = lambda rows: spark.createDataFrame([(i, *v) for i, v in rows.items()], schema)
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "doc_id long")
    index = TextIndex(spark, fresh(spark, "index")).build(frame(rows), {"body": 1.0, "title": 0.5}, width=8)
    want = lambda: plain_scores([(i, *v) for i, v in rows.items()], ["alpha", "rare"])
    got = lambda: [(r.score, r.doc_id, r.n_terms) for r in index.search(["alpha", "rare"], 1000).collect()]
    gone = [i for i in rows if 0 <= i < 24]  # whole ranges, and parts of some
    changed = [i for i in rows if i % 30 == 0 and i not in gone]
    for i in gone:
        del rows[i]
    for i in changed:
        rows[i] = ("rare rare beta", None)
    rows[9999] = ("alpha rare", "rare")
    gen = index.update(frame(rows), ids([*gone, *changed, 9999, None]))
    assert got() == want() and gen == 1
    assert index.update(frame(rows), ids([*gone, *changed, 9999]), gen=gen) == 1 and got() == want()  # a replay
    index.compact()
    assert got() == want() and index._generations() == [2]
    empty = TextIndex(spark, fresh(spark, "index")).build(frame(rows).limit(0), {"body": 1.0}, width=8)
    assert empty.search(["alpha"], 3).collect() == []
    assert query_terms("Alpha, alpha BETA! " + "z" * 2000)[:2] == ["alpha", "beta"] and len(query_terms(" ".join(map(str, range(99))))) == 32


def test_index_of_dates(spark):
    r = random.Random(3)
    rows = [(i, f"alpha {'beta ' * r.randint(0, 3)}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 2) if i % 9 else None) for i in range(100)]
    index = TextIndex(spark, fresh(spark, "index")).build(spark.createDataFrame(rows, "doc_id long, body string, date date"), {"body": 1.0}, width=10, day="date")
    scores = plain_scores([(i, t) for i, t, _ in rows], ["beta"], (1.0,))
    day = {i: d for i, _, d in rows}
    want = [x[1] for x in scores if day[x[1]] and dt.date(2024, 1, 10) <= day[x[1]] <= dt.date(2024, 1, 20)]
    assert [x.doc_id for x in index.search(["beta"], 6, "2024-01-10", "2024-01-20").collect()] == want[:6]


def test_index_of_cjk_and_questions(spark):
    r = random.Random(14)
    words = ["今天", "北京", "下雨", "我们", "学习", "中文", "图书馆", "很好"]
    rows = [(i, "".join(r.choices(words, k=6)) + (" the Rain x2北京" if i % 7 == 0 else "")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = {w: n for w, n in segment.free_strings(df).items() if w in words or len(w) == 1}
    index = TextIndex(spark, fresh(spark, "index")).build(df, {"text": 1.0}, width=16, dictionary=known)
    again = TextIndex(spark, index.path)  # as another session would open it
    got = {x.doc_id for x in again.ask("北京下雨", 500).collect()}
    assert got == {i for i, t in rows if "北京" in t or "下雨" in t}
    assert again.search(["京下"], 5).collect() == []  # no word
    assert {x.doc_id for x in again.ask("the rain", 500, frozenset({"the"})).collect()} == {i for i, t in rows if "Rain" in t}
    assert {x.doc_id for x in again.search(["rain"], 500, without=["图书馆"]).collect()} == {i for i, t in rows if "Rain" in t and "图书馆" not in t}
    assert {x.doc_id for x in again.search(["x2"], 3, without=["图书馆"]).collect()} == set(sorted(i for i, t in rows if "x2" in t and "图书馆" not in t)[:3]) or len(again.search(["x2"], 3, without=["图书馆"]).collect()) == 3


# runs -----------------------------------------------------------------------------------------------------------------
def test_runs_stay_few_and_replays_change_nothing(spark):
    r = random.Random(4)
    schema = "k long, v string, version long, deleted boolean"
    runs, last = Runs(spark, fresh(spark, "runs"), schema, "k", fanout=2), {}
    for number in range(7):
        rows = [(r.randint(0, 20), f"{number}-{i}", number * 100 + i // 2, r.random() < 0.3 or None) for i in range(12)] + [(None, "x", 1, None)]
        batch = spark.createDataFrame(rows, schema)
        for k, v, version, gone in rows:
            if k is not None and (k not in last or version >= last[k][0]):
                last[k] = (version, v, bool(gone))
        runs.apply(batch, number)
        if number in (1, 5):
            before = runs.live()
            runs.apply(batch, number)  # the stream failed after it had written, and sends the batch again
            assert runs.live() == before
        levels = Counter(level for level, _ in runs.live())
        assert max(levels.values()) < 2 and len(levels) <= 3
    got = {x.k: (x.version, x.v) for x in runs.read().collect()}
    # of equal versions within one batch either may stay
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in last.items() if not v[2] or k in got}
    assert set(got) >= {k for k, v in last.items() if not v[2] and sum(1 for x in last.values() if x[0] == v[0]) == 1} - {k for k, v in last.items() if v[2]}
    assert runs._read([n for _, n in runs.live()]).count() <= 3 * 21


def test_runs_drop_tombstones_at_the_last_level(spark):
    schema = "k long, version long, deleted boolean"
    runs = Runs(spark, fresh(spark, "runs"), schema, "k", fanout=2)
    for number, gone in enumerate((False, True)):
        runs.apply(spark.createDataFrame([(i, number, gone) for i in range(5)], schema), number)
    assert runs.read().count() == 0 and runs._read([n for _, n in runs.live()]).count() == 0
    assert Runs(spark, fresh(spark, "runs"), schema, "k").read().count() == 0


# names ----------------------------------------------------------------------------------------------------------------
def plain_names(text, dictionary):
    own = names_pieces(text)
    found = []
    for e, n in dictionary:
        p = names_pieces(n or "")
        found += [(len(n), at, len(p), e) for at in range(len(own) - len(p) + 1) if p and own[at : at + len(p)] == p]
    kept: list = []
    for size, at, n, e in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if all(at + n <= a or a + m <= at or (a, m) == (at, n) for _, a, m, _ in kept):
            kept.append((size, at, n, e))
    return Counter(e for *_, e in kept)


def names_pieces(text):
    import re

    return re.findall(names.PIECE, (text or "").lower())


def test_embedded_names_like_a_plain_version(spark):
    r = random.Random(6)
    words = ["ab", "b", "c-d", "日本", "本", "ab_c", "x", "#"]
    dictionary = [(f"e{i}", " ".join(r.choices(words, k=r.randint(1, 4)))) for i in range(25)] + [("e1", "ab"), ("e2", "ab"), ("none", None), ("blank", " ")]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "AB  b\nab")]
    got = defaultdict(dict)
    for row in names.embedded_names(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(dictionary, "entity_id string, name string")).collect():
        got[row.doc_id][row.entity_id] = row.n
    for i, t in texts:
        assert got.get(i, {}) == dict(plain_names(t, sorted(set(dictionary), key=str))), t
    assert names.embedded_names(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "entity_id string, name string")).count() == 0


def test_plan_of_names_doesnt_grow(spark):
    texts = spark.createDataFrame([(1, "a name")], "doc_id long, text string")
    plan = lambda n: len(names.embedded_names(texts, spark.range(n).select(F.lit("e").alias("entity_id"), F.concat(F.lit("n"), "id").alias("name")))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(10) - plan(100_000)) < 50


# similar strings ------------------------------------------------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize(("least", "gap", "hot"), [(0.85, 2, 1000), (0.6, 2, 1), (0.7, 4, 2), (1.0, 2, 1)])
def test_similar_pairs_like_all_pairs(spark, least, gap, hot):
    r = random.Random(8)
    base = ["".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(40)]
    words = list(base)
    for w in base:
        x = list(w)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randint(0, 1)] = r.choice(["", "z", "a"])
        words.append("".join(x))
    words += ["same prefix " + c for c in "abcdefgh"] + [None, "", "ab"]
    got = {(x.a, x.b): x.distance for x in similar.similar_pairs(spark.createDataFrame([(w,) for w in words], "name string"), least, gap, hot=hot).collect()}
    want = {(a, b): d for a, b in itertools.combinations(sorted({w for w in words if w}), 2) if abs(len(a) - len(b)) <= gap and 1 - (d := distance(a, b)) / max(len(a), len(b)) >= least - 1e-9}
    assert got == want


# graph ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("hub", [1, 1000])
def test_neighbours_of_all_starts_like_walks(spark, hub):
    r = random.Random(9)
    edges = list({(f"n{r.randint(0, 14)}", r.choice("rst"), f"n{r.randint(0, 14)}") for _ in range(22)}) + [("n0", "r", f"leaf{i}") for i in range(6)]
    ways = [(a, b, (rel, a, b)) for a, rel, b in edges] + [(b, a, (rel, a, b)) for a, rel, b in edges]
    best = {}
    for start in ("n0", "n1", "n2", "alone"):
        layer = {start: ()}
        seen = {start}
        for h in range(1, 4):
            nxt = {}
            for node, path in layer.items():
                for a, b, e in ways:
                    if a == node and b not in seen:
                        p = (*path, e)
                        key = tuple(tuple(x[k] for x in p) for k in range(3))
                        if b not in nxt or key < nxt[b][0]:
                            nxt[b] = (key, p)
            for b, (key, _) in nxt.items():
                best[start, b] = (h, *key)
            seen |= set(nxt)
            layer = {b: p for b, (_, p) in nxt.items()}
    starts = spark.createDataFrame([("n0",), ("n1",), ("n2",), ("n2",), ("alone",), (None,)], "id string")
    got = {(x.start, x.id): (x.hops, tuple(x.relations), tuple(x.sources), tuple(x.targets)) for x in reach.all_neighbours(spark.createDataFrame(edges, "source string, relation string, target string"), starts, 3, hub).collect()}
    assert got == best


def test_neighbours_of_leaves_without_their_pairs(spark, monkeypatch):
    edges = [(f"s{i}", "in", f"n{i % 2}") for i in range(120)] + [("n0", "of", "r"), ("n1", "of", "r"), ("p", "with", "q")]
    rows = []

    def counted(df, what):
        rows.append(df.count())
        return kept(df, what)

    kept = reach.written
    monkeypatch.setattr(reach, "written", counted)
    starts = spark.createDataFrame([(x,) for x in {v for a, _, b in edges for v in (a, b)}], "id string")
    found = reach.all_neighbours(spark.createDataFrame(edges, "source string, relation string, target string"), starts, 3, 50)
    assert sum(rows) < 15 * len(edges)  # in all; pairs of leaves are 7,080 and are in the result only
    got = {(x.start, x.id): (x.hops, *x.relations) for x in found.collect()}
    assert found.count() == len(got) == 2 * 60 * 59 + 3 * 120 + (2 * 120 + 4) + (2 + 120) + 2
    assert got["s0", "s2"] == (2, "in", "in") and got["s0", "n1"] == (3, "in", "of", "of") and got["n0", "s1"] == (3, "of", "of", "in") and got["p", "q"] == (1, "with")


def test_merges_through_chains_rings_and_undo(spark):
    log = [(1, "a", "b", None), (2, "b", "c", None), (3, "c", "d", None), (4, "x", "y", None), (5, "y", "z", None), (6, "z", "x", None), (7, "p", "x", None), (8, "b", "q", None), (9, "s", "s", None), (10, "u", "v", None), (11, None, None, 10), (12, None, "a", None), (13, "k0", "k1", None)]
    log += [(100 + i, f"k{i}", f"k{i + 1}", None) for i in range(1, 40)] + [(200, "m", "n", None), (201, "n", "m", None)]
    df = spark.createDataFrame(log, "seq long, source string, target string, undoes long")
    got = {r.id: r.root for r in reach.resolved(reach.active_merges(df)).collect()}
    want = {"a": "d", "b": "d", "c": "d", "x": "z", "y": "z", "p": "z", "m": "n"} | {f"k{i}": "k40" for i in range(40)}
    assert got == want
    undone = df.unionByName(spark.createDataFrame([(300, None, None, 2)], df.schema))
    got = {r.id: r.root for r in reach.resolved(reach.active_merges(undone)).collect()}
    assert got["a"] == "q" and got["b"] == "q"  # the next merge of b counts instead
    assert reach.resolved(reach.active_merges(df.limit(0))).collect() == []
    nodes = spark.createDataFrame([("a", "A", ["one"]), ("b", "B", None), ("c", "C", ["A"]), ("d", "D", ["D"])], "id string, name string, aliases array<string>")
    edges = spark.createDataFrame([("a", "knows", "e"), ("b", "knows", "e"), ("a", "knows", "c"), ("e", "likes", "b")], "source string, relation string, target string")
    kept, ties = reach.merged_graph(nodes, edges, df)
    assert [(r.id, r.aliases) for r in kept.collect()] == [("d", ["A", "B", "C", "one"])]
    assert sorted(tuple(r) for r in ties.collect()) == [("d", "knows", "e"), ("e", "likes", "d")]


# hash trees -----------------------------------------------------------------------------------------------------------
def test_hash_tree_reads_what_changed(spark):
    rows = {i: (f"t{i}", None if i % 5 else "") for i in range(0, 4000, 2)}
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "k long, a string, b string")
    old = frame(rows)
    tree = HashTree(spark, fresh(spark, "tree"), fanout=8).build(old, "k")
    new_rows = dict(rows) | {7: ("new", None), 8: ("t8", "")}
    new_rows[10], new_rows[4] = ("t10", ""), ("t4", "changed")
    del new_rows[3000]
    new = frame(new_rows)
    touched = spark.createDataFrame([(k,) for k in (7, 8, 10, 4, 3000)], "key long")
    other = tree.updated(fresh(spark, "tree"), new, "k", touched)
    again = HashTree(spark, fresh(spark, "tree"), fanout=8).build(new, "k")
    for k in range(tree.height() + 1):
        assert sorted(map(tuple, other._level(k).collect())) == sorted(map(tuple, again._level(k).collect()))
    want = {(k, "added" if k not in rows else "removed" if k not in new_rows else "changed") for k in set(rows) | set(new_rows) if rows.get(k) != new_rows.get(k)}
    assert {tuple(r) for r in changes(old, new, "k", tree, other).collect()} == want
    pages, read = tree.differing(other)
    assert {r.page for r in pages.collect()} == {k // 8 for k, _ in want} and sum(read) < 70 < tree._level(0).count()
    same, read = tree.differing(tree)
    assert same.count() == 0 and sum(read) <= 2


# summaries ------------------------------------------------------------------------------------------------------------
def test_rolling_percentile_like_sorting(spark):
    r = random.Random(10)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=r.choice([0, 1, 2, 3, 9, 10, 30])), r.choice([0.0, -3.5, 1e-9, 7.0, r.gauss(0, 100), 1e12])) for _ in range(500)] + [(None, 1.0), (dt.date(2024, 1, 2), None), (dt.date(2024, 1, 2), float("nan"))]
    df = spark.createDataFrame(rows, "date date, value double")
    for share, days in ((0.95, 7), (0.5, 1), (1.0, 3)):
        got = {x.day: (x.n, x.value) for x in sketches.rolling_percentile(df, share, days).collect()}
        good = [(d, v) for d, v in rows if d and v is not None and v == v]
        for end in {d for d, _ in good}:
            own = sorted(v for d, v in good if end - dt.timedelta(days=days - 1) <= d <= end)
            assert got[end] == (len(own), own[math.ceil(round(share * len(own), 9)) - 1])
        assert len(got) == len({d for d, _ in good})
    assert sketches.rolling_percentile(df.limit(0)).count() == 0


def test_top_terms_with_few_counters(spark):
    r = random.Random(11)
    terms = [f"w{i}" for i in range(400)]
    rows = [(list(dict.fromkeys(r.choices(terms, [400 / (i + 1) for i in range(400)], k=20))),) for _ in range(1500)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "terms array<string>").repartition(4)
    want = sorted(Counter(t for (ts,) in rows for t in ts or ()).items(), key=lambda x: (-x[1], x[0]))
    for k, most in ((5, 60), (10, 4), (50, 100), (1000, 20)):
        assert [(x.term, x.df) for x in sketches.top_terms(df, k, most=most).collect()] == want[:k]


def test_runs_sort_no_rows_before_they_are_dealt_out(spark):
    runs = Runs(spark, fresh(spark, "runs"), "k long, v string, version long, deleted boolean", "k", fanout=2)
    for n in range(3):
        runs.apply(spark.createDataFrame([(k, f"{n}", n, k == 7) for k in range(n, 20)], "k long, v string, version long, deleted boolean"), n)
    found = runs.read()
    assert {(r.k, r.v) for r in found.collect()} == {(0, "0"), (1, "1"), *((k, "2") for k in range(2, 20) if k != 7)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    ready = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert ready.count("Exchange") == 1 and "Sort" not in ready.split("Exchange")[1], plan


# segmentation ---------------------------------------------------------------------------------------------------------
def test_lattice_takes_the_likeliest_cut():
    r = random.Random(12)
    lattice = segment.Lattice({"".join(r.choice("ab") for _ in range(r.randint(1, 3))): r.randint(1, 50) for _ in range(12)} | {"abab": 3})
    for _ in range(200):
        run = "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        cuts = [[run[a:b] for a, b in itertools.pairwise([0, *marks, len(run)])] for k in range(len(run)) for marks in itertools.combinations(range(1, len(run)), k)] if run else [[]]
        cost = lambda words: sum(map(lattice.cost, words))
        got = lattice.cut(run)
        assert "".join(got) == run and math.isclose(cost(got), min(map(cost, cuts)), abs_tol=1e-9)


def test_words_of_unspaced_text_by_branching_entropy(spark):
    r = random.Random(13)
    words = ["今天", "北京", "下雨", "我们", "学习", "中文", "图书馆", "很好"]
    texts = [(i, "".join(r.choices(words, k=12))) for i in range(200)] + [(900, None), (901, "plain text")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counts = segment.word_counts(df) | segment.free_strings(df)
    # parts of words, and words with parts of others, aren't free
    assert {w for w in counts if len(w) > 1 and segment._RUN.fullmatch(w)} >= set(words) and "图书" not in counts and "天北" not in counts
    got = {x.doc_id: x.words for x in segment.segmented(df, {w: n for w, n in counts.items() if w in words or len(w) == 1}).collect()}
    assert all("".join(got[i]) == t for i, t in texts[:200]) and set(got[0]) <= set(words) and got[900] == []


def test_cutting_follows_beginnings_of_words_only():
    counts = {"a": 5, "ab": 4, "b" * 6000: 2, "cab": 3}
    t = time.monotonic()
    lattice = segment.Lattice(counts)
    assert lattice.cut("cabab" * 6000) == ["cab", "ab"] * 6000 and lattice.cut("b" * 6000 + "xab") == ["b" * 6000, "x", "ab"]
    assert time.monotonic() - t < 30  # trying each length at each place takes minutes


@pytest.mark.parametrize("few", [1, 64])
def test_cuts_over_arrays_like_the_lattice(few, monkeypatch):
    """Many strings cut at once: the same words as one by one, ties and characters of no word among them, whatever lies beside a string."""
    import random

    from almanack.operators.segment import Cutter, Lattice

    monkeypatch.setattr(Cutter, "few", few)
    rng = random.Random(7)
    for letters, n in (("ab", 12), ("abcdé世😀", 60), ("abcdefgh", 400), ("ab", 0)):
        counts = {"".join(rng.choices(letters, k=rng.randint(1, 5))): rng.choice([1, 2, 2, 8]) for _ in range(n)}
        texts = [["".join(rng.choices(letters + "?", k=rng.choice([0, 1, 3, 40, 300]))) for _ in range(rng.randint(0, 3))] for _ in range(60)] + [[letters * 500]]
        lattice = Lattice(counts)
        assert Cutter(counts).cut(texts).to_pylist() == [[w for r in runs for w in lattice.cut(r)] for runs in texts]
    assert Cutter({"a": 1}).cut([]).to_pylist() == [] and Cutter({"a": 1}).cut([[], [""]]).to_pylist() == [[], []]


def test_quality_of_cuts_of_long_texts(spark):
    r = random.Random(21)
    texts = [(i, r.choice(["en", None]), [r.choice(["a", "bc", "日本", "def", "𝒳y"]) for _ in range(n)]) for i, n in enumerate([0, 1, 5, 40, 200_000])]
    again = lambda ws: [x for w in ws for x in ([w[:1], w[1:]] if len(w) > 1 and r.random() < 0.3 else [w])]
    cuts = [(i, again(ws)) for i, _, ws in texts] + [(77, ["other"])]
    ends = lambda ws: set(zip(itertools.accumulate(map(len, ws)), map(len, ws), strict=True))
    want = {}
    for (_, lang, t), (_, f) in zip(texts, cuts, strict=False):
        n = want.setdefault(lang, [0, 0, 0])
        for k, x in enumerate((len(t), len(f), len(ends(t) & ends(f)))):
            n[k] += x
    true, found = spark.createDataFrame(texts, "doc_id long, lang string, words array<string>"), spark.createDataFrame(cuts, "doc_id long, words array<string>")
    rows = segment.cut_quality(found, true, "lang")
    # words are placed in time in proportion to them, not by arrays that grow word by word
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {x.lang: [x.n_true, x.n_found, x.n_right] for x in rows.collect()} == want


# streams --------------------------------------------------------------------------------------------------------------
def test_silence_of_a_stream_with_late_rows_and_restarts(spark):
    day = dt.datetime(2024, 5, 1)
    at = lambda h: day + dt.timedelta(hours=h)
    files = [
        [(1, at(0)), (1, at(2)), (2, at(1)), (None, at(1)), (3, None)],
        [(1, at(12)), (2, at(11)), (2, at(10.5))],  # user 1 and 2 were silent
        [(3, at(30)), (1, at(29)), (2, at(29.5))],
        [(3, at(29.2)), (2, at(12.5)), (4, at(34)), (1, at(29.1))],  # 12.5 is too late
        [(3, at(60)), (1, at(36)), (1, at(61))],
    ]
    source, target, checkpoint = (fresh(spark, f"test-silence-{x}") for x in ("source", "target", "checkpoint"))
    schema = "user_id long, ts timestamp"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if k in (0, 2, 4):
            silence.run(spark, source, schema, target, checkpoint, 6 * 3600, "2 hours")
    silence.run(spark, source, schema, target, checkpoint, 6 * 3600, "2 hours")  # nothing came
    got = sorted((r.user_id, r["last"]) for r in spark.read.schema(silence.OUT).parquet(target).collect())
    kept = [r for rows in files for r in rows if r != (2, at(12.5))]
    want = sorted((r.user_id, r["last"]) for r in silence.batch_silences(spark.createDataFrame(kept, schema), 6 * 3600, "2 hours").collect())
    assert got == want and (1, at(2)) in got and (2, at(11)) in got and (4, at(34)) in got and (3, at(60)) not in got


@pytest.mark.parametrize("small", [0, 3, 64])
def test_related_entries_by_rare_and_frequent_values(spark, small):
    """Both ways against all pairs, with nulls; with rare values compared in whole fewer rows are made than one a set of columns."""
    import random
    from datetime import date, timedelta

    from almanack.operators.graph import related

    rnd = random.Random(7)
    rows = [(i, date(2024, 1, 1) + timedelta(rnd.randrange(90)), rnd.choice([None, "a", "b", "c", "d"]), rnd.choice([None, "x", "y"]), i % 40) for i in range(120)]
    points = {"p": 40, "q": 30, "r": 20}
    found = related(spark.createDataFrame(rows, "doc_id long, date date, p string, q string, r int"), points, small=small)
    expected = set()
    for a in rows:
        own = []
        for b in rows:
            gap = abs((a[1] - b[1]).days)
            score = sum(n for k, n in enumerate(points.values()) if a[2 + k] is not None and a[2 + k] == b[2 + k]) + (max(1, 10 - min(gap, 9)) if gap <= 30 else 0)
            if a[0] != b[0] and score > 0:
                own.append((-score, gap, -b[0]))
        expected |= {(a[0], -i, -s, k + 1) for k, (s, _, i) in enumerate(sorted(own)[:5])}
    assert {(r.doc_id, r.related, r.score, r.place) for r in found.collect()} == expected


def test_names_that_begin_alike_meet_only_their_own_places(spark):
    """Rows that the joins make grow with the places, not with the names that begin as they do."""
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("by Unit#"), "id", F.lit(" and Unit#"), F.col("id") + 1).alias("text"))
    dictionary = spark.range(1000).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.concat(F.lit("unit#"), "id").alias("name"))
    hits = names._hits(texts, names._forms(dictionary)[0], "text", "doc_id")
    assert hits.count() == 400
    seen = {(r.doc_id, r.entity_id, r.n) for r in names.embedded_names(texts, dictionary).collect()}
    assert seen == {(i, f"e{k}", 1) for i in range(200) for k in (i, i + 1)}


def test_places_without_a_name_carry_no_pieces(spark):
    texts = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("from Acme Works; by Bolt").alias("text"))
    found = names.occurrences(texts, spark.createDataFrame([("a", "acme works"), ("b", "bolt"), ("c", "works of acme ltd")], "entity_id string, name string"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # no array of windows for all places of a text
    assert {(x.start, x.n, x.entity_id) for x in found.collect()} == {(1, 2, "a"), (5, 1, "b")} and found.count() == 40


def test_mentions_of_entities_with_a_name_in_common(spark):
    entries = spark.createDataFrame([(i, dt.date(2024, 1, 1) + dt.timedelta(i // 2), "Ann Ann" if i % 3 else "Bo, ann") for i in range(60)], "doc_id long, date date, body string")
    dictionary = spark.createDataFrame([("x", "ann"), ("y", "Ann"), ("y", "bo"), ("z", "bo")], "entity_id string, name string")
    found = {(r.entity_id, r.place): r.doc_id for r in names.mentions_of(entries, dictionary, 5).collect()}
    assert found == {(e, k + 1): i for e, ids in (("x", range(59, -1, -1)), ("y", range(59, -1, -1)), ("z", range(57, -1, -3))) for k, i in enumerate(list(ids)[:5])}


def test_index_shuffles_parts_of_blocks_once(spark, tmp_path):
    """A word of all entries goes through the shuffle a few times a range, and compaction keeps what a search finds."""
    from almanack.sources import text_index

    entries = spark.range(512).select(F.col("id").alias("doc_id"), F.concat(F.lit("all w"), F.col("id") % 8).alias("text"))
    parts = entries.select("doc_id", F.lit(None).cast("int").alias("day"), "text").coalesce(1).mapInArrow(text_index._counted([1.0], 256), text_index._PART)
    assert parts.filter("term = 'all'").count() <= 4 and parts.filter("term = 'all'").agg(F.sum(F.size("docs"))).collect()[0][0] == 512
    index = TextIndex(spark, fresh(spark, "index")).build(entries, {"text": 1.0}, width=256)
    index.update(entries.filter("doc_id <> 5"), spark.range(5, 6).select(F.col("id").alias("doc_id")))
    before = [tuple(r) for r in index.search(["all", "w5"], 20).collect()]
    index.compact()
    assert [tuple(r) for r in index.search(["all", "w5"], 20).collect()] == before and before[0][0] == 13


def test_index_makes_whole_blocks_and_shuffles_no_postings(spark, tmp_path):
    """A range of more entries than a batch has is one block, with its figures and print; words are those of words_of()."""
    import pyarrow as pa

    from almanack.sources import text_index

    texts = ["Größe, αβγ_δ x1²  世界和平 e\u0301a", "", "--", "Ⅷ a_b a", None, "𐐀𝟘 😀 ok", "end"]
    words, of = text_index._words(pa.array([(x or "").lower() for x in ["cut", *texts]], pa.string()).slice(1))
    assert list(zip(of.tolist(), words.to_pylist(), strict=True)) == [(i, w) for i, x in enumerate(texts) for w in text_index.words_of((x or "").lower())]
    rows = [(i, None if i % 3 else i, " ".join(["all"] * (1 + i % 2)) + f" w{i % 8}", "all" if i % 2 else "", i) for i in range(1400)]
    schema = pa.schema([("doc_id", pa.int64()), ("day", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("h", pa.int64())])
    batches = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema).to_batches(100)
    found = [r for b in text_index._counted([1.0, 0.5], 700)(iter(batches)) for r in b.to_pylist()]
    for no in (0, 1):
        (block,) = [r for r in found if (r["term"], r["range_no"]) == ("all", no)]
        own = [r for r in rows if r[0] // 700 == no]
        assert block["docs"] == [r[0] for r in own] and block["days"] == [r[1] for r in own]
        assert block["tfs"] == [1.0 + i % 2 * 1.5 for i, *_ in own] and block["dls"] == [2 + i % 2 * 2 for i, *_ in own]
        assert (block["n"], block["max_tf"], block["min_dl"], block["sum_dl"]) == (700, 2.5, 2, None)
        assert (block["min_day"], block["max_day"]) == (min(r[1] for r in own if r[1] is not None), max(r[1] for r in own if r[1] is not None))
        (block,) = [r for r in found if (r["term"], r["range_no"]) == ("", no)]
        assert (block["n"], block["sum_dl"], block["print"]) == (700, 2100, sum(r[4] for r in own))
    assert len(found) == 2 * 10


def test_search_reads_pages_of_its_terms(spark):
    """Pages of a file are small beside it, when indexed and after compaction, so a term's blocks are found without reading the others."""
    entries = spark.range(64).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.concat(F.lit("w"), (F.col("id") * 1000 + k).cast("string")))).alias("text"))
    index = TextIndex(spark, fresh(spark, "index")).build(entries, {"text": 1.0}, width=64)
    for _ in range(2):
        rows = index._postings().filter("term = 'w777'")
        assert [r.docs for r in rows.select("docs").collect()] == [[0]]
        plan = rows.select("docs")._jdf.queryExecution().executedPlan()
        assert plan.executeCollect() and plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value() <= 2000
        index.update(entries, spark.range(1).select(F.col("id").alias("doc_id")))
        index.compact()


def test_duplicates_make_each_pair_once_and_shuffle_none(spark):
    from almanack.operators.entities import duplicates

    rows = [(i, ["Anna", "Ana", "Bob"][i % 3], [f"a{i % 4}", f"b{i % 4}"], "confirmed") for i in range(36)]
    found = duplicates(spark.createDataFrame(rows, "id long, name string, aliases array<string>, status string"), spark.createDataFrame([(4, 0)], "a long, b long"))
    rank = lambda a, b: "alias_overlap" if a[1] == b[1] or set(a[2]) & set(b[2]) else "edit_distance" if {a[1], b[1]} == {"Anna", "Ana"} else None
    expected = sorted((a[0], b[0], rank(a, b)) for a, b in itertools.combinations(rows, 2) if rank(a, b) and (a[0], b[0]) != (0, 4))
    assert sorted((r.id1, r.id2, r.signal) for r in found.collect()) == expected
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [2, 5, 2048])
def test_duplicates_by_blocks_and_no_side_broadcast(spark, most):
    """Entities of a key in one block or several, and with the same keys in two; what is paired is never sent to all tasks."""
    from almanack.operators.entities import duplicates

    rows = [(f"i{i:02}", ["Anna", "Ana", "mom", "妈妈"][i % 4], [f"a{i % 3}", None] if i % 5 else None, "confirmed") for i in range(40)]
    seen = {("i08", "i00"), ("i01", "i04"), ("i02", "i07")}
    found = duplicates(spark.createDataFrame(rows, "id string, name string, aliases array<string>, status string"), spark.createDataFrame(list(seen), "a string, b string"), most=most)
    keys = lambda r: {r[1], *(r[2] or [])} - {None}
    rank = lambda a, b: "alias_overlap" if keys(a) & keys(b) else "kinship" if (a[1], b[1]) == ("妈妈", "mom") else "edit_distance" if {a[1], b[1]} == {"Anna", "Ana"} else None
    expected = sorted((a[0], b[0], rank(a, b)) for a, b in itertools.combinations(rows, 2) if rank(a, b) and not {(a[0], b[0]), (b[0], a[0])} & seen)
    assert sorted((r.id1, r.id2, r.signal) for r in found.collect()) == expected
    assert {x[2] for x in expected} == {"alias_overlap", "kinship", "edit_distance"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan, plan


def test_timers_of_silence_only_where_ends_change():
    import pandas as pd

    class Handle:
        rows, calls = [], []

        def getListState(self, *_):
            return self

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def registerTimer(self, t):
            self.calls.append(("set", t))

        def deleteTimer(self, t):
            self.calls.append(("drop", t))

    handle, own = Handle(), silence._Silence(10_000_000)
    own.init(handle)
    for us in ([0, 50_000_000], [1_000_000, 50_000_000], [50_000_000]):
        own.handleInputRows((1,), iter([pd.DataFrame({"us": us})]), None)
    assert sorted(handle.calls) == [("drop", 10_001), ("set", 10_001), ("set", 11_001), ("set", 60_001)]
