"""Toxicity: Levenshtein automata over a trie of learnt terms, and scores of the words around each hit.

1. Terms. Over labelled documents that may be learnt from, Spark counts for each word the clean texts that hold it and the
   different contexts in which toxic texts have it first (so copies and near copies count once). Words whose smoothed
   log-odds for toxic are high are the terms.
2. Misspellings. The terms form a trie; it is intersected with Levenshtein automata (one error from five letters on, two
   from nine), and the product is made deterministic state by state as words are read. A word of the labelled texts that
   the automaton takes for a term is no misspelling if clean texts have it: it gets its own log-odds instead.
3. Context. Words, quotation marks, verbs of reporting and second persons in a window around a hit have log-odds of being
   in a toxic text, learnt from the hits in labelled texts and shrunk to stated values where there are few. Their sum gives
   the chance that a hit is abuse and not quotation; a hit's weight is multiplied by it.
4. Score. A logistic model of the hits' figures. Terms are learnt on one half of the labelled texts for the other half
   (halves by the text's hash), so the model sees hits as they will be on unseen texts.

Bounds: some max_labelled labelled documents are learnt from (by hash of their ids), of these max_scored for the logistic
model; max_terms terms, max_known clean words near them, max_context context words. Scores cover all documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, pieces, small_batches, table, written

#: Words, with signs that stand for letters only between letters; quotation marks are tokens of their own.
TOKEN = re.compile(r"\w+(?:[@$*]+\w+)*|[\"“”„«»]")
QUOTES = frozenset('"“”„«»')
#: TOKEN finds the same in a text without any of these signs.
_SIGNS, _PLAIN = re.compile("[@$*\"“”„«»]"), re.compile(r"\w+")
WINDOW = 5
BLOCK = 200_000  # characters that are tokens at a time
FEATURES = 7
# Words beside a hit that speak of quotation, and of address. Their log-odds before anything is learnt.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word words term terms means meaning sagte schrieb wort zitat nannte dit écrit mot citation appelé dijo escribió palabra cita llamó".split())
ADDRESS = frozenset("you your yours you're du dich dir dein ihr euch tu te toi vous ton votre usted tú eres vosotros".split())
PRIOR = {"<quoted>": -2.0, "<reporting>": -1.5, "<address>": 1.0}


def allowed(term: str) -> int:
    """Errors that a misspelling of the term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The trie of terms intersected with their Levenshtein automata.

    A state is a set of (trie node, errors so far), of which a node's fewest errors count. States and their transitions are
    worked out when a word first needs them; most words leave the automaton after a few letters.
    """

    MOST_STATES = 50_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[int, int]] = [{}]
        self.ends, self.most, self.depth = [-1], [0], max(map(len, terms), default=0)
        alphabet = sorted({c for t in terms for c in t})
        self.codes = np.zeros(0x110000, np.uint16)  # letters of no term are one letter, 0
        self.codes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.letters = len(alphabet) + 1
        for k, term in enumerate(terms):
            node = 0
            for c in (0, *self.codes[list(map(ord, term))].tolist()):  # the first step is the root itself
                if c:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.ends)
                        self.children.append({})
                        self.ends.append(-1)
                        self.most.append(0)
                    node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed(term))
            self.ends[node] = k
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps = np.full((256, self.letters), -2, np.int32)  # -2: not worked out yet, -1: no state
        self.found: list = []
        self.start = self._number({0: 0}) if self.terms else -1

    def _number(self, reached: dict[int, int]) -> int:
        """The state of these nodes and errors, with all nodes that leaving out letters of a term leads to; -1 if there is none."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        if not reached:
            return -1
        key = frozenset(reached.items())
        if key not in self.numbers:
            ends = [(e, self.ends[n]) for n, e in reached.items() if self.ends[n] >= 0 and e <= allowed(self.terms[self.ends[n]])]
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.found.append(min(ends, default=None))
            if len(self.sets) > len(self.steps):
                self.steps = np.concatenate((self.steps, np.full_like(self.steps, -2)))
        return self.numbers[key]

    def _step(self, state: int, c: int) -> None:
        reached: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.most[node]:
                reached[node] = min(e + 1, reached.get(node, 99))
            for letter, child in self.children[node].items():
                x = e if letter == c else e + 1
                if x <= self.most[child] and x < reached.get(child, 99):
                    reached[child] = x
        to = self._number(reached)
        self.steps[state, c] = to

    def matches(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Of the words that some term is within its errors of: (errors, number of the nearest term, of equals the first). All words move in step."""
        if len(self.sets) > self.MOST_STATES:
            self._forget()
        words = [w for w in words if 0 < len(w) <= self.depth + 2]
        if not words or self.start < 0:
            return {}
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.codes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin, state, live = np.cumsum(size) - size, np.full(len(words), self.start), np.arange(len(words))
        for at in range(self.depth + 2):
            live = live[size[live] > at]
            if not len(live):
                break
            own, c = state[live], codes[begin[live] + at]
            to = self.steps[own, c]
            if (new := to == -2).any():
                for key in np.unique(own[new] * self.letters + c[new]).tolist():
                    self._step(*divmod(key, self.letters))
                to = self.steps[own, c]
            state[live] = to
            live = live[to >= 0]
        ended = np.flatnonzero(state >= 0)
        return {words[k]: m for k in ended.tolist() if (m := self.found[state[k]])}

    def match(self, word: str):
        return self.matches([word]).get(word)


def token_blocks(text: str):
    """Tokens of a lower-cased text in blocks of bounded size, cut at white space."""
    text, at = text.lower(), 0
    token = TOKEN if _SIGNS.search(text) else _PLAIN
    while True:
        end = at + BLOCK
        while end < len(text) and not text[end].isspace():
            end += 1
        yield token.findall(text, at, end)
        if end >= len(text):
            return
        at = end


def context(tokens: list[str], k: int, quoted: bool) -> set[str]:
    """The words in the window around token k, with marks for quotation, reporting and address."""
    around = tokens[max(0, k - WINDOW) : k] + tokens[k + 1 : k + 1 + WINDOW]
    out = {w for w in around if w not in QUOTES}
    if quoted or (k and tokens[k - 1] in QUOTES and k + 1 < len(tokens) and tokens[k + 1] in QUOTES):
        out.add("<quoted>")
    if not REPORTING.isdisjoint(out):
        out.add("<reporting>")
    if not ADDRESS.isdisjoint(out):
        out.add("<address>")
    return out


class Lexicon:
    """Terms with weights, clean words near them with their own, and log-odds of context words."""

    def __init__(self, terms: dict[str, float], known: dict[str, float], contexts: dict[str, float] | None = None, decay: float = 0.7):
        self.names = sorted(terms)
        self.weights = [terms[t] for t in self.names]
        self.known, self.contexts, self.decay = known, dict(PRIOR) | (contexts or {}), decay
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}  # each worker makes its own states

    def hot(self, words) -> dict[str, tuple[float, int, str]]:
        """(weight, errors, term) of those of the words that are hits."""
        if self.automaton is None:
            self.automaton = Automaton(self.names)
        out = {}
        for w, (e, k) in self.automaton.matches(list(words)).items():
            weight = self.known.get(w, self.weights[k] * self.decay**e) if e else self.weights[k]
            if weight > 0:
                out[w] = weight, e, self.names[k]
        return out

    def hits(self, text: str, blocks=None, hot: dict | None = None):
        """(word, its weight, errors, term, context) of each hit, in order; at the end the number of words as an int.

        blocks and hot: the text's tokens and the hits among its words, where they are known.
        """
        words, tail, begin, open_ = 0, [], 0, 0
        blocks = iter(blocks if blocks is not None else token_blocks(text))
        block = next(blocks, [])
        while block is not None:
            following = next(blocks, None)
            tokens = tail + block
            stop = len(tokens) if following is None else max(begin, len(tokens) - WINDOW)
            own = tokens[begin:stop]
            known = hot if hot is not None else self.hot(set(own))
            marks = [k for k, w in enumerate(own) if w in QUOTES] if not QUOTES.isdisjoint(own) else []
            words += len(own) - len(marks)
            if not known.keys().isdisjoint(own):
                for k in [k for k, w in enumerate(own) if w in known]:
                    yield (own[k], *known[own[k]], context(tokens, begin + k, open_ != bisect_left(marks, k) % 2))
            open_ = (open_ + len(marks)) % 2
            keep = max(0, stop - WINDOW)
            tail, begin, block = tokens[keep:], stop - keep, following
        yield words

    def many(self, texts: list[str]):
        """hits() of each text. Words of short texts are looked up together, some hundred thousand characters at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and len(texts[end]) < BLOCK and size < 4 * BLOCK:
                size += len(texts[end])
                end += 1
            if end == at:
                yield self.hits(texts[at])
                at += 1
                continue
            tokens = [next(token_blocks(t)) for t in texts[at:end]]
            hot = self.hot(set().union(*tokens))
            for t, own in zip(texts[at:end], tokens, strict=True):
                yield self.hits(t, (own,), hot)
            at = end

    def abuse(self, around: set[str]) -> float:
        """The chance that a hit among these words is abuse."""
        z = 2.0 + sum(self.contexts.get(w, 0.0) for w in around)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def figures(self, found) -> tuple[list[float], int, int, int]:
        """Features of a text, by its hits(); how many hits, misspelt ones and quoted ones."""
        best: dict[str, float] = {}
        n = exact = quoted = words = 0
        chance = 0.0
        for hit in found:
            if isinstance(hit, int):
                words = hit
                continue
            w, weight, e, _, around = hit
            a = self.abuse(around)
            n, exact, quoted, chance = n + 1, exact + (e == 0), quoted + ("<quoted>" in around), chance + a
            best[w] = max(best.get(w, 0.0), weight * a)
        return [max(best.values(), default=0.0), math.log1p(sum(best.values())), math.log1p(len(best)), math.sqrt(n / words) if words else 0.0, exact / n if n else 0.0, chance / n if n else 0.0, math.log1p(words) / 10 if n else 0.0], n, n - exact, quoted


class Toxicity:
    """A lexicon and the logistic model of its figures."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and, last, the constant: Newton's method with a ridge on the weights."""
    z = np.hstack((x, np.ones((len(x), 1))))
    ridge = np.diag([l2] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ w)).sum() + 0.5 * w @ ridge @ w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        scale = 1.0
        while loss(w - scale * step) > loss(w) and scale > 1e-4:
            scale /= 2
        w = w - scale * step
        if abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id="doc_id"):
    """True for rows whose labels aren't learnt from: crc32 of the id's decimal text leaves 1 when divided by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _counted(batches):
    """(word, half, ctx, clean): for toxic texts a row a word with the context of its first place; for clean ones the number of texts."""
    clean: Counter = Counter()

    def flush():
        if clean:
            keys = list(clean)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.nulls(len(keys), pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["word", "half", "ctx", "clean"])
            clean.clear()

    for batch in pieces(batches):
        out: list = []
        for half, label, text in zip(*(batch.column(c).to_pylist() for c in ("half", "label", "text")), strict=True):
            first: dict[str, int] = {}
            before = ""
            for block in token_blocks(text):
                for k, w in enumerate(block):
                    if w not in first and w not in QUOTES and len(w) <= 64:
                        first[w] = xxhash.xxh64_intdigest(f"{before} {block[k + 1] if k + 1 < len(block) else ''}") >> 1 if label else 0
                    before = w
            first[""] = xxhash.xxh64_intdigest(" ".join(list(first)[:8])) >> 1  # stands for the text itself
            if label:
                out.extend((w, half, ctx) for w, ctx in first.items())
            else:
                clean.update((w, half) for w in first)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()), pa.array([0] * len(out), pa.int64())], names=["word", "half", "ctx", "clean"])
        if len(clean) > 100_000:
            yield from flush()
    yield from flush()


def _log_odds(toxic: float, clean: float, rate: float, prior: float = 4.0) -> float:
    """Log-odds of toxic given the word less those of any text, as if `prior` more texts of the usual mixture had the word."""
    return math.log((toxic + prior * rate) / (clean + prior * (1 - rate))) - math.log(rate / (1 - rate))


def _lexicon(counts: DataFrame, halves: tuple[int, ...], sizes: dict, max_terms: int, max_known: int, least: float) -> Lexicon | None:
    """The lexicon of these halves' counts; None where they have no toxic or no clean text."""
    toxic, clean = (sum(sizes[h][k] for h in halves) for k in (0, 1))
    if not toxic or not clean:
        return None
    rate = toxic / (toxic + clean)
    total = lambda c: sum((F.col(f"{c}{h}") for h in halves[1:]), F.col(f"{c}{halves[0]}"))
    own = counts.filter("word != ''").select("word", total("t").alias("t"), total("c").alias("c"))
    odds = F.log((F.col("t") + 4.0 * rate) / (F.col("c") + 4.0 * (1 - rate))) - math.log(rate / (1 - rate))
    terms = own.filter("t >= 2 and length(word) >= 3").withColumn("w", odds).filter(F.col("w") >= least)
    chosen = {r.word: r.w for r in terms.orderBy(F.desc(F.col("w") * F.sqrt("t")), "word").limit(max_terms).select("word", "w").collect()}
    found = Lexicon(chosen, {})
    if not chosen:
        return found
    shared = counts.sparkSession.sparkContext.broadcast(found)

    def near(batches):
        lexicon = shared.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            close = lexicon.hot(words)
            yield batch.filter(pa.array([w not in chosen and w in close for w in words], pa.bool_()))

    known = own.filter("c >= 1").select("word", "t", "c").mapInArrow(near, "word string, t long, c long").orderBy(F.desc("c"), "word").limit(max_known).collect()
    return Lexicon(chosen, {r.word: _log_odds(r.t, r.c, rate) for r in known})


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def training(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = 20_000) -> DataFrame:
    """half, label, text and pick (0 to 1, by hash) of the labelled rows that are learnt from: ids by hash, some max_labelled, twice that at most.

    Held-out ids, nulls, ids with both labels and texts without a character are left out; a repeated label counts once. So
    few ids are broadcast, and no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"), (F.min("label") == F.max("label")).alias("agreed")).filter("agreed").drop("agreed")
    share = min(1.0, max_labelled / max(known.count(), 1))
    known = known.filter(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < share).orderBy(F.xxhash64("doc_id")).limit(2 * max_labelled)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out())
    key = F.xxhash64("text")
    return own.join(F.broadcast(known), "doc_id").select(F.pmod(key, F.lit(2)).cast("int").alias("half"), F.col("label").cast("int"), "text", (F.pmod(F.xxhash64("doc_id", key), F.lit(2**30)) / 2.0**30).alias("pick"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = 20_000, max_scored: int = 6000, max_terms: int = 5000, max_known: int = 50_000, max_context: int = 2000, least: float = 2.0) -> Toxicity:
    """Learn terms, context words and the logistic model. Without labels of both classes in both halves every score is 0."""
    spark = small_batches(docs.sparkSession)
    rows = written(training(docs, labels, label_col, max_labelled), "toxicity-training")
    per_half = rows.select("half", "label", "text").mapInArrow(frees(_counted), "word string, half int, ctx long, clean long").groupBy("word", "half").agg(F.count_distinct("ctx").alias("t"), F.sum("clean").alias("c"))
    side = lambda c, h: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0))
    wide = per_half.groupBy("word").agg(*(side(c, h).alias(f"{c}{h}") for c in "tc" for h in (0, 1)))
    counts = written(wide.filter("t0 + t1 + c0 + c1 >= 2 or word = ''"), "toxicity-counts")
    sizes = {0: (0, 0), 1: (0, 0)}
    for r in counts.filter("word = ''").collect():  # one row
        sizes = {0: (r.t0, r.c0), 1: (r.t1, r.c1)}
    halves = [_lexicon(counts, (h,), sizes, max_terms, max_known, least) for h in (1, 0)]  # for texts of half 0, of half 1
    whole = _lexicon(counts, (0, 1), sizes, max_terms, max_known, least)
    nothing = Toxicity(whole or Lexicon({}, {}), np.array([0.0] * FEATURES + [-30.0]))
    if not whole or not all(halves):
        return nothing
    shared = spark.sparkContext.broadcast(halves)

    def _by_half(batch):
        """(lexicon, hits) of each row, by the lexicon of the other half."""
        texts, halves_ = _texts(batch), batch.column("half").to_pylist()
        found: list = [None] * len(texts)
        for h in (0, 1):
            rows = [k for k, x in enumerate(halves_) if x == h]
            for k, hits_ in zip(rows, shared.value[h].many([texts[k] for k in rows]), strict=True):
                found[k] = shared.value[h], list(hits_)
        return found

    def contexts(batches):
        seen: Counter = Counter()
        for batch in pieces(batches):
            for label, found in zip(batch.column("label").to_pylist(), _by_half(batch), strict=True):
                around: set[str] = set()
                for hit in found[1]:
                    if not isinstance(hit, int):
                        around |= hit[4]
                around.add("")
                seen.update((w, label) for w in around if len(w) <= 64)
            if len(seen) > 100_000:
                yield _rows(seen)
        yield _rows(seen)

    def _rows(seen):
        keys = list(seen)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["word", "label", "n"])
        seen.clear()
        return out

    told = rows.select("half", "label", "text").mapInArrow(frees(contexts), "word string, label int, n long").groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"))
    top = told.filter("t + c >= 5").orderBy(F.desc(F.col("t") + F.col("c")), "word").limit(max_context + 1).collect()
    learnt = {}
    base = {r.word: r for r in top}.get("")
    rate = (base.t + 1) / (base.t + base.c + 2) if base else 0.5
    for r in top:
        if r.word:  # shrunk to the stated value as if 50 more texts told it; ordinary words are held within 0.3
            n = r.t + r.c
            z = (n * _log_odds(r.t, r.c, rate) + 50 * PRIOR.get(r.word, 0.0)) / (n + 50)
            learnt[r.word] = z if r.word in PRIOR else max(-0.3, min(0.3, z))
    for lexicon in (*halves, whole):
        lexicon.contexts.update(learnt)
    shared.destroy()
    shared = spark.sparkContext.broadcast(halves)

    def features(batches):
        for batch in pieces(batches):
            x = [lexicon.figures(found)[0] for lexicon, found in _by_half(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    n = sum(sum(s) for s in sizes.values())
    sample = rows.filter(F.col("pick") < min(1.0, max_scored / max(n, 1))).select("half", "label", "text").mapInArrow(frees(features), "label int, x array<double>").orderBy("label", "x").limit(4 * max_scored).collect()
    shared.destroy()
    y = np.array([r.label for r in sample])
    if len(set(y.tolist())) < 2:
        return nothing
    return Toxicity(whole, logistic(np.array([r.x for r in sample]), y))


def scored(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score (0 to 1), n_hits, n_misspelt and n_quoted of every row; null and empty texts have no hit, but a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            lexicon = shared.value.lexicon
            found = [lexicon.figures(h) for h in lexicon.many(_texts(batch))]
            x = np.array([f[0] for f in found], float).reshape(-1, FEATURES)
            columns = [batch.column("doc_id"), pa.array(shared.value.score(x)), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "n_hits", "n_misspelt", "n_quoted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frees(run), "doc_id long, score double, n_hits long, n_misspelt long, n_quoted long")


def hits(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, word, term, errors, weight, abuse (the context's chance of abuse) and quoted of every hit."""
    shared = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    schema = "doc_id long, word string, term string, errors int, weight double, abuse double, quoted boolean"

    def run(batches):
        for batch in pieces(batches):
            out = [(i, w, term, e, weight, shared.value.abuse(around), "<quoted>" in around) for i, found in zip(batch.column("doc_id").to_pylist(), shared.value.many(_texts(batch)), strict=True) for w, weight, e, term, around in (h for h in found if not isinstance(h, int))]
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frees(run), schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model learnt from the labels of rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_hits", "n_misspelt", "n_quoted")
