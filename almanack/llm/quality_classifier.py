"""Quality classifier by co-training of two views.

One logistic model sees the text's content (frequencies of hashed byte trigrams, shares of letter classes; line breaks
count as blanks), the other the page's metadata (language, source, length, layout of lines), so the views have no feature
in common. Both learn from a bounded sample of labelled documents. In each round both score all unlabelled documents; the
ones that a view is surest of, by its own calibration on labelled documents it hasn't learnt from, are labelled for the
other view, which learns from these as well. After the last round both learn once more, are calibrated on held-out
labelled documents, and their calibrated scores are combined into one, for every document, in one pass without shuffle.

Bounds: max_labelled documents are learnt from, on the driver, and at most `each` pseudo-labels per class, view and round.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, give_back, pieces, small_batches, table, written
from .jaccard_join import Words

TRIGRAMS, CLASSES, META = 2048, 8, 64
_LINE_END = re.compile(rb"[.!?:;\"')]\s*$")
_UPPER, _DIGIT, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58], _SPACE[[32, 9, 10, 11, 12, 13]] = True, True, True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&|<>{}[]=+~^_\\@!")] = True


#: Line breaks and tabs as blanks: the layout of lines is the other view's.
_FLAT = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))


def text_features(raw: bytes) -> np.ndarray:
    """Roots of trigram frequencies, then shares of signs, capitals, digits, white space, and how varied trigrams are."""
    x = np.zeros(TRIGRAMS + CLASSES, np.float32)
    b = np.frombuffer(raw.translate(_FLAT), np.uint8)
    if len(b) >= 3:
        v = b.astype(np.uint32)
        h = (v[:-2] * np.uint32(0x9E3779B1) + v[1:-1] * np.uint32(0x85EBCA77) + v[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
        n = np.bincount(h, minlength=TRIGRAMS)
        x[:TRIGRAMS] = np.sqrt(n / len(h))
        x[TRIGRAMS + 4] = np.count_nonzero(n) / min(len(h), TRIGRAMS)
        x[TRIGRAMS + 5] = np.sqrt(n.max() / len(h))
    if len(b):
        for k, mask in enumerate((_SIGN, _UPPER, _DIGIT, _SPACE)):
            x[TRIGRAMS + k] = np.sqrt(np.count_nonzero(mask[b]) / len(b))
    return x


def meta_features(raw: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, length, and the layout of lines."""
    x = np.zeros(META, np.float32)
    x[xxhash.xxh32_intdigest(lang or "") % 16] = 1
    x[16 + xxhash.xxh32_intdigest(source or "") % 32] = 0.5
    lines = [s for s in raw.split(b"\n") if s.strip()]
    size = np.log1p(max(n_chars or 0, 0)) / 10
    x[48:52] = size, size * size, np.log1p(len(lines)) / 5, np.log1p(len(raw) / max(1, len(lines))) / 10
    if lines:
        x[52] = 1 - len(set(lines)) / len(lines)
        x[53] = sum(bool(_LINE_END.search(s[-8:])) for s in lines) / len(lines)
        x[54] = sum(len(s) < 40 for s in lines) / len(lines)
    return x


def _rows(batch: pa.RecordBatch):
    """(text, lang, source, n_chars) of each row; missing columns are null."""
    names = batch.schema.names
    col = lambda c: batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows
    return zip([x or b"" for x in batch.column(names.index("text")).cast(pa.binary()).to_pylist()], col("lang"), col("source"), col("n_chars"), strict=True)


def _features(batches):
    for batch in pieces(batches):
        a, b = [], []
        for raw, *meta in _rows(batch):
            a.append(text_features(raw).astype(np.float16).tobytes())
            b.append(meta_features(raw, *meta).astype(np.float16).tobytes())
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([batch.column(names.index("key")), batch.column(names.index("doc_id")), batch.column(names.index("label")), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["key", "doc_id", "label", "a", "b"])


def _logit(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> np.ndarray:
    """Weights (the last one is the offset) of a logistic model, classes weighted alike."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)), dtype=np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float32, copy=False) @ w[:-1] + w[-1]


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset that make z a log-odds: Newton steps, with targets drawn in so that sure data stay finite."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a: float, b: float) -> float:
        u = a * z + b
        return float((np.logaddexp(0, u) - t * u).sum() + 0.05 * ((a - 1) ** 2 + b * b))

    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((p - t) * z).sum() + 0.1 * (a - 1), (p - t).sum() + 0.1 * b])
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        d, step, now = np.linalg.solve(h, g), 1.0, loss(a, b)
        while step > 1e-4 and loss(a - step * d[0], b - step * d[1]) > now:  # Newton's step can overshoot
            step /= 2
        a, b = a - step * d[0], b - step * d[1]
        if step * abs(d).max() < 1e-6:
            break
    return float(a), float(b)


class Model:
    """Two fitted views, their calibrations and the threshold."""

    def __init__(self, wa, wb, ca, cb, threshold: float = 0.5, prior: float = 0.0):
        self.wa, self.wb, self.ca, self.cb, self.threshold, self.prior = wa, wb, ca, cb, threshold, prior

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the views, and their combination: the log-odds that each adds to those of the class by itself."""
        za, zb = self.ca[0] * _raw(a, self.wa) + self.ca[1], self.cb[0] * _raw(b, self.wb) + self.cb[1]
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p(za), p(zb), p(za + zb - self.prior)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of a batch's rows, and which are kept. A text without a word is not."""
        rows = list(_rows(batch))
        out = []
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            out.append(self.scores(np.array([text_features(r[0]) for r in part]), np.array([meta_features(*r) for r in part])))
        pa_, pb_, p = (np.concatenate(x).astype(np.float64) for x in zip(*out, strict=True)) if out else (np.empty(0),) * 3
        return pa_, pb_, p, (p >= self.threshold) & np.array([bool(r[0].strip()) for r in rows], bool)


def _surest(fitted: dict, each: int):
    """Of a task's rows (doc_id, text, ...): the `each` surest of each view and class, by log-odds; rows of equal features in the view, told by a hash of them, once."""

    def run(batches):
        best: dict = {}
        for batch in pieces(batches):
            rows = list(_rows(batch))
            ids = batch.column(batch.schema.names.index("doc_id")).to_pylist()
            x = {"a": np.array([text_features(r[0]) for r in rows], np.float32).reshape(-1, TRIGRAMS + CLASSES), "b": np.array([meta_features(*r) for r in rows], np.float32).reshape(-1, META)}
            for view, (w, scale) in fitted.items():
                # the fifth place evens out the order of a product's sums, which hangs on where a row stands in its batch
                z = np.round((scale[0] * _raw(x[view], w) + scale[1]).astype(float), 5)
                for label, sure in ((1, z), (0, -z)):
                    seen = best.setdefault((view, label), {})
                    for k in np.argsort(-sure, kind="stable")[: 4 * each]:
                        key = xxhash.xxh64_intdigest(x[view][k].tobytes()) >> 1
                        seen[key] = max(seen.get(key, (-np.inf, 0)), (float(sure[k]), -ids[k]))
                    if len(seen) > 16 * each:
                        best[view, label] = dict(sorted(seen.items(), key=lambda s: s[1], reverse=True)[: 4 * each])
        out = [(v, y, s, -i, h) for (v, y), seen in best.items() for h, (s, i) in sorted(seen.items(), key=lambda s: s[1], reverse=True)[:each]]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["view", "label", "sure", "doc_id", "same"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 3000, rounds: int = 2, each: int = 100, sure: float = 0.9) -> Model:
    """Fit by co-training. labels: doc_id and a 0/1 column; nulls, unknown ids and ids with both labels are ignored, repeats count once.

    Without labels of both classes everything is kept. Of rows that share a labelled id at most 2 * max_labelled are learnt
    from, those whose texts hash least.
    """
    spark = small_batches(docs.sparkSession)
    share = lambda n, most: F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < min(1.0, most / max(n, 1))
    known = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("long").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"), (F.min("label") == F.max("label")).alias("agreed")).filter("agreed").drop("agreed")
    known = known.filter(share(known.count(), max_labelled)).orderBy(F.xxhash64("doc_id")).limit(2 * max_labelled)
    own = _own(docs).filter("doc_id is not null")

    def features(rows: DataFrame, most: int):
        # features first: whole texts don't go through the one task that orders the rows
        made = rows.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(frees(_features), "key long, doc_id long, label long, a binary, b binary")
        found = made.orderBy("key").limit(most).drop("key").toPandas().sort_values(["doc_id", "a", "b"], kind="stable")
        view = lambda c, k: np.frombuffer(b"".join(found[c]), np.float16).reshape(-1, k)
        out = {"a": view("a", TRIGRAMS + CLASSES), "b": view("b", META)}, found["label"].to_numpy("int64"), found["doc_id"].to_numpy("int64")
        del found
        give_back()  # the driver's Python holds no more than the features
        return out

    x, y, ids = features(own.join(F.broadcast(known), "doc_id"), 2 * max_labelled)
    order = np.arange(len(y))
    held, probe, train = order[::5], order[1::5], order[(order % 5 > 1)]
    flat = lambda k: np.zeros(k + 1, np.float32)
    if any(len(set(y[part])) < 2 for part in (held, probe, train)):
        return Model(flat(TRIGRAMS + CLASSES), flat(META), (1.0, 0.0), (1.0, 0.0), 0.0)
    more = {v: (x[v][:0], y[:0]) for v in x}  # what each view was given by the other
    taken = set(ids.tolist())

    def learnt() -> dict:
        return {v: _logit(np.concatenate((x[v][train], more[v][0])), np.concatenate((y[train], more[v][1])).astype(np.float32), 1e-4 if v == "a" else 1e-5) for v in x}

    for _ in range(rounds):
        fitted = {v: (w, _platt(_raw(x[v][probe], w).astype(float), y[probe])) for v, w in learnt().items()}
        gone = spark.createDataFrame([(i,) for i in sorted(taken)], "doc_id long")
        top = own.join(F.broadcast(gone), "doc_id", "left_anti").mapInArrow(frees(_surest(fitted, each)), "view string, label long, sure double, doc_id long, same long").filter(F.col("sure") >= math.log(sure / (1 - sure)))
        top = written(top.groupBy("view", "label", "same").agg(F.max("sure").alias("sure"), F.min("doc_id").alias("doc_id")), "surest")
        chosen = [r for v in ("a", "b") for y in (0, 1) for r in top.filter((F.col("view") == v) & (F.col("label") == y)).orderBy(F.desc("sure"), "doc_id").limit(each).collect()]
        for v, other in (("a", "b"), ("b", "a")):
            told = {r.doc_id: r.label for r in chosen if r.view == v}
            if not told:
                continue
            given = spark.createDataFrame(sorted(told.items()), "doc_id long, label long")
            fx, fy, fi = features(own.join(F.broadcast(given), "doc_id"), 4 * each)
            more[other] = np.concatenate((more[other][0], fx[other])), np.concatenate((more[other][1], fy))
            taken.update(fi.tolist())
    final = learnt()
    ca, cb = (_platt(_raw(x[v][held], final[v]).astype(float), y[held]) for v in ("a", "b"))
    good = (y == 1).mean()
    give_back()
    return Model(final["a"], final["b"], ca, cb, prior=float(np.log(good / (1 - good))))


#: Anything in ASCII but letters and digits as a blank.
_LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


class Lexical:
    """Score of a text by the word that tells most for the positive class. Words are compared by 64-bit hashes."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, scale: tuple):
        self.keys, self.weights, self.scale = keys, weights, scale

    def most(self, words: np.ndarray) -> float:
        if not len(words) or not len(self.keys):
            return 0.0
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return float(np.max(np.where(self.keys[at] == words, self.weights[at], 0.0)))

    def scores(self, texts) -> np.ndarray:
        cut = Words()
        z = np.array([self.most(cut.hashes(t.translate(_LETTERS))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


def fit_lexical(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = 3000, least: int = 3) -> Lexical:
    """Words' log-odds over a bounded sample of labelled documents (as in fit()), of words that `least` positive ones or more hold."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("long").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"), (F.min("label") == F.max("label")).alias("agreed")).filter("agreed").drop("agreed").orderBy(F.xxhash64("doc_id")).limit(max_labelled)

    def words(batches):
        cut = Words()
        for batch in pieces(batches):
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(cut.hashes((x or b"").translate(_LETTERS))).tobytes() for x in raw], pa.binary())], names=["label", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(max_labelled).select("label", "text")
    found = rows.mapInArrow(words, "label long, words binary").toPandas()
    y, sets = found["label"].to_numpy("int64"), [np.frombuffer(x, np.uint64) for x in found["words"]]
    order = np.arange(len(y))
    held, train = order[::4], order[order % 4 > 0]
    none = np.empty(0, np.uint64)
    if len(set(y[held])) < 2 or len(set(y[train])) < 2:
        return Lexical(none, np.empty(0), (0.0, -30.0))
    sides = []
    for label in (1, 0):
        sides.append(np.unique(np.concatenate([none, *(sets[k] for k in train if y[k] == label)]), return_counts=True))
    (keys, n1), (other, n0) = sides
    keys, n1 = keys[n1 >= least], n1[n1 >= least]
    at = np.minimum(np.searchsorted(other, keys), max(len(other) - 1, 0))
    n0 = np.where(other[at] == keys, n0[at], 0) if len(other) else np.zeros(len(keys))
    pos, neg = (y[train] == 1).sum(), (y[train] == 0).sum()
    weights = np.log((n1 + 0.5) / (pos + 1)) - np.log((n0 + 0.5) / (neg + 1))
    model = Lexical(keys, weights, (1.0, 0.0))
    z = np.array([model.most(sets[k]) for k in held])
    model.scale = _platt(z, y[held])
    return model


def _score(models):
    def run(batches):
        model, toxic = models.value
        for batch in pieces(batches):
            x, y, p, kept = model.of(batch)
            columns = {"doc_id": batch.column(0), "text_score": pa.array(x), "meta_score": pa.array(y), "score": pa.array(p), "kept": pa.array(kept)}
            if toxic:
                t = toxic.scores(r[0] for r in _rows(batch))
                columns |= {"toxic_score": pa.array(t), "toxic": pa.array(t >= 0.5)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in ("lang", "source", "n_chars") if c in docs.columns))


def judge(docs: DataFrame, model: Model, toxic: Lexical | None = None) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept of every row, and toxic_score and toxic by a second model, if one is given.

    Null and blank texts are not kept; other nulls are values of their own. Being toxic doesn't change kept.
    """
    more = ", toxic_score double, toxic boolean" if toxic else ""
    return _own(docs).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast((model, toxic))), "doc_id long, text_score double, meta_score double, score double, kept boolean" + more)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(shared.value.of(batch)[3]))

    return docs.mapInArrow(frees(run), docs.schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier fitted on the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels), fit_lexical(docs, labels))
