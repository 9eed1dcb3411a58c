"""Operators 11 to 13 against plain versions, on small tables with nulls, odd vectors, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from almanack.llm import centroid_clustering, toxicity, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, code string, row string, v string"


def vectors(n: int, dims: int, seed: int) -> list:
    """Rows with ties, copies, repeated and null ids, and vectors to leave out."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims)) / 4
    out = [(i, (centres[i % 5] + r.normal(size=dims) / 9).round(2).tolist(), int(i % 3) if i % 7 else None) for i in range(n)]
    out += [(1000, out[0][1], 1)] * 60 + [(3, out[5][1], 2), (None, out[6][1], None), (-4, out[7][1], 0)]
    nan, inf = float("nan"), float("inf")
    out += [(2000, None, 1), (2001, [nan] + [0.0] * (dims - 1), 1), (2002, [inf] + [0.0] * (dims - 1), 1), (2003, [None] + [0.0] * (dims - 1), 1), (2004, [0.5] * (dims - 8), 1), (2005, [], None)]
    return [(*row, "clash", "clash", "clash", "clash") for row in out]


def whole(v, scale: int) -> np.ndarray | None:
    ok = v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)
    return np.floor(np.array(v, np.float32).astype(float) * scale).astype(np.int64) if ok else None


@pytest.mark.parametrize(("n", "k"), [(150, 8), (3, 8)])
def test_centroid_clustering_like_plain_lloyd(spark, n, k):
    given = vectors(max(n, 20), 64, n)[: n if n == 3 else None]
    kept = [(i, x) for i, v, *_ in given if (x := whole(v, 1024)) is not None and len(x) == 64]
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x.tolist()) for i, x in kept if i is not None)
    c, x = np.array([v for _, v in hashed[:k]]), np.stack([v for _, v in kept])
    for step in range(11):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if step < 10:
            c = np.stack([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    best = d.min(1)
    names = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    want = sorted((repr(i), int(own[j]), int(best[j]), int(best[own == own[j]].sum()), int(best.sum()), names[own[j]]) for j, (i, _) in enumerate(kept))
    got = centroid_clustering.clustered(spark.createDataFrame(given, SCHEMA)).collect()
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == want


def test_clustering_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroid_clustering.clustered(none).collect() == [] and vector_codes.compressed(none).collect() == []
    with pytest.raises(Exception, match="or more"):
        centroid_clustering.clustered(spark.createDataFrame([(1, [3e38] * 64, 0, "", "", "", "")], SCHEMA)).collect()


def test_only_changed_centroids_are_compared():
    r = np.random.default_rng(2)
    x, c = r.integers(-50, 50, (300, 6)), r.integers(-50, 50, (9, 6))
    owner, held = centroid_clustering.nearest(x, c, np.ones(9, bool), np.full(300, -1), np.zeros(300, np.int64))
    new = c.copy()
    new[[2, 5]] += r.integers(-9, 9, (2, 6))
    changed = (new != c).any(1)
    owner, held = centroid_clustering.nearest(x, new, changed, owner, held)
    d = ((x[:, None] - new[None]) ** 2).sum(2)
    assert (owner == d.argmin(1)).all() and (held == d.min(1)).all()
    big = np.array([[2**26] * 64, [-(2**26)] * 64])
    assert centroid_clustering.distances(big, big).tolist() == [[0, 64 * 2**54], [64 * 2**54, 0]]


@pytest.mark.parametrize("n", [150, 5])
def test_vector_codes_like_a_plain_version(spark, n):
    given = vectors(max(n, 20), 32, n)[: n if n == 5 else None]
    kept = [(i, x, label) for i, v, label, *_ in given if (x := whole(v, 4096)) is not None and len(x) == 32]
    first = sorted((i is None, i or 0, x.tolist()) for i, x, _ in kept)[:16]
    x = np.stack([v for _, v, _ in kept]).reshape(len(kept), 8, 4)
    books = np.array([v for *_, v in first]).reshape(len(first), 8, 4).transpose(1, 0, 2)
    for step in range(7):
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        code = d.argmin(2)
        if step < 6:
            books = np.stack([np.stack([x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum() if (code[:, p] == e).any() else books[p, e] for e in range(len(first))]) for p in range(8)])
    error = d.min(2).sum(1)
    by: dict = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    want = sorted((repr(i), "".join(f"{c:02x}" for c in code[j]), int(error[j]), by[label], digest) for j, (i, _, label) in enumerate(kept))
    # the vector of no component has another length than the rest, as has the short one
    got = vector_codes.compressed(spark.createDataFrame(given, SCHEMA)).collect()
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


def test_annuli_are_exact_and_prune():
    r = np.random.default_rng(1)
    entries = r.integers(-900, 900, (64, 4)) * np.repeat(np.arange(1, 9), 8)[:, None]
    entries[[3, 9]] = entries[20]  # equals: the lower number
    x = np.concatenate((r.integers(-7000, 7000, (500, 4)), entries, np.zeros((2, 4), int)))
    a = vector_codes.Annuli(entries)
    code, best = a.nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all() and a.evaluated < 0.7 * d.size


def test_codes_decode_to_their_entries(spark):
    books = np.arange(8 * 16 * 2).reshape(8, 16, 2) * 4096
    (row,) = vector_codes.decoded(spark.createDataFrame([(1, "000102030405060f")], "vec_id long, code string"), books).collect()
    assert row.approximation == [float(x) for p, e in enumerate((0, 1, 2, 3, 4, 5, 6, 15)) for x in books[p, e] // 4096]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_like_plain_distances(monkeypatch):
    r = random.Random(4)
    terms = sorted({"".join(r.choice("abcé") for _ in range(r.randint(3, 11))) for _ in range(60)})
    words = terms + ["".join(r.choice("abcdé") for _ in range(r.randint(0, 13))) for _ in range(1500)]
    for t in terms:
        for _ in range(8):
            w = list(t)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = r.choice(["", "x", "a"])
            words.append("".join(w))
    for most in (50_000, 40):  # states are forgotten and made again
        monkeypatch.setattr(toxicity.Automaton, "MOST_STATES", most)
        a = toxicity.Automaton(terms)
        for w in words:
            want = min(((d, k) for k, t in enumerate(terms) if (d := levenshtein(w, t)) <= toxicity.allowed(t)), default=None)
            assert a.match(w) == want, w
    assert toxicity.Automaton([]).match("a") is None


def test_hits_are_the_same_in_any_blocks(monkeypatch):
    lexicon = toxicity.Lexicon({"idiot": 4.0, "worthless": 3.0}, {"idiom": -1.0})
    r = random.Random(7)
    words = ["idiot", "idi0t", "wortles", "idiom", "fine", '"', "you", "said", "a,", "«", "»", "\n"]
    for n in (0, 1, 5, 6, 300):
        text = " ".join(r.choice(words) for _ in range(n))
        monkeypatch.setattr(toxicity, "BLOCK", 200_000)
        whole_ = list(lexicon.hits(text))
        for size in (1, 7, 40):
            monkeypatch.setattr(toxicity, "BLOCK", size)
            assert list(lexicon.hits(text)) == whole_
            assert [list(h) for h in lexicon.many(["", text, "idiot", text])][1:4:2] == [whole_, whole_]
    assert [h if isinstance(h, int) else (h[0], h[2], h[3]) for h in lexicon.hits("IDIOT wortles, idiom st")] == [("idiot", 0, "idiot"), ("wortles", 2, "worthless"), 4]


def test_quotation_counts_less_than_abuse():
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {})
    plain, quoted, address = (lexicon.figures(lexicon.hits(t))[0][0] for t in ("what an idiot that was", 'he said the word "idiot" means a fool', "you are an idiot"))
    assert quoted < 0.5 * plain < plain < address
    assert lexicon.figures(lexicon.hits('"a idiot b" c'))[3] == 1 and lexicon.figures(lexicon.hits(""))[0] == [0.0] * toxicity.FEATURES


def made(n: int, seed: int) -> tuple[list, list]:
    r = random.Random(seed)
    words = ["".join(r.choice("aeinorst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    bad = ["grumbleknot", "fizzwad", "snorkbag", "drivelhead"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        if toxic:
            for _ in range(4):
                w = list(r.choice(bad))
                if r.random() < 0.5:
                    w[r.randrange(len(w))] = r.choice("xyz")
                text[r.randrange(len(text))] = "".join(w)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_of_misspelt_terms(spark):
    docs, labels = made(600, 3)
    odd = [(None, "fizzwad"), (7000, None), (7001, ""), (7002, "fizzvad snorkbaq drivelhaed grumbleknott " * 3), (7002, "nothing"), (7003, "word " * 300_000 + "fizzwad " * 9)]
    table = spark.createDataFrame([(i, t, "en", "src", 9, 0.5, True) for i, t in docs + odd], "doc_id long, text string, lang string, source string, n_hits long, score double, held_out boolean")
    known = spark.createDataFrame(labels + [(3, 1), (None, 1), (5, None), (10, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, known)
    assert {"fizzwad", "snorkbag"} <= set(model.lexicon.names)
    got = toxicity.scored(table, model).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(by[i].score >= 0.7) == (i % 5 == 0) for i in out]
    assert sum(right) > 0.97 * len(right)
    assert by[7000].score == by[7001].score < 0.5 and by[7000].n_hits == 0 and by[7003].n_hits == 9
    spelt = [r for r in got if r.doc_id == 7002]
    assert sorted(r.score >= 0.7 for r in spelt) == [False, True] and max(r.n_misspelt for r in spelt) == 12
    found = toxicity.hits(table.filter("doc_id = 7002"), model).collect()
    assert {(r.word, r.term) for r in found} == {("fizzvad", "fizzwad"), ("snorkbaq", "snorkbag"), ("drivelhaed", "drivelhead"), ("grumbleknott", "grumbleknot")}


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs, labels = made(300, 8)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    turned = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (toxicity.fit(table, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a.lexicon.names == b.lexicon.names and np.allclose(a.weights, b.weights)
    got = {r.doc_id: r.h for r in table.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(h == held(i) for i, h in got.items())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    table = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {r.score < 0.01 for r in toxicity.scored(table, toxicity.fit(table, none)).collect()} == {True}
    assert toxicity.scored(table.limit(0), toxicity.fit(table.limit(0), none)).collect() == []


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs.join(labels.select("doc_id"), "doc_id", "left_semi").filter(toxicity.held_out()), model).join(labels, "doc_id").collect()
    toxic, clean = [r.score >= 0.7 for r in got if r.toxic == 1], [r.score >= 0.7 for r in got if r.toxic == 0]
    assert sum(toxic) > 0.85 * len(toxic) > 100 and sum(clean) < 0.01 * len(clean)
