"""Words of unspaced text: a dictionary learnt from a corpus, and the likeliest path through the lattice of its words.

The dictionary has two sources. Where texts have spaces, words are counted. Runs of CJK characters have none: there, strings of
two to four characters are words if they occur often and are free on both sides, that is, if the characters before and after
them vary (branching entropy). A path's likelihood is the product of its words' shares; a character that no word covers is a
piece of its own, at a price.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CJK = "[぀-ヿ㐀-䶿一-鿿가-힯]"
_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(f"{CJK}+")


def word_counts(texts: DataFrame, column: str = "text", least: int = 2, most: int = 200_000, longest: int = 24) -> dict[str, int]:
    """The `most` most frequent words of spaced texts (lower case) that occur `least` times or more, counted over all texts; summed in the
    tasks first. Strings of more than `longest` characters are no words."""

    short = re.compile(rf"(?<![^\W_])[^\W_]{{1,{longest}}}(?![^\W_])")  # whole words only

    def count(batches):
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for text in whole.column(0).slice(at, 256).to_pylist():
                    words = short.findall(text := (text or "").lower())
                    held.update([w for w in words if not _RUN.search(w)] if _RUN.search(text) else words)
                if len(held) > 200_000:
                    yield rows()
        yield rows()

    found = texts.select(F.col(column).cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r.word: r.n for r in found.orderBy(F.desc("n"), "word").limit(most).collect()}


def free_strings(texts: DataFrame, column: str = "text", longest: int = 4, least: int = 5, entropy: float = 1.0, most: int = 200_000) -> dict[str, int]:
    """Strings of 2 to `longest` CJK characters that occur `least` times or more with a branching entropy of `entropy` bits or more on
    both sides (ends of runs are characters of their own kind each time), and all single characters; with counts."""
    run = texts.select(F.explode(F.regexp_extract_all(column, F.lit(f"{CJK}+"), 0)).alias("run"))
    at = F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at")
    grams = run.select("run", at).select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))).alias("n"))
    side = lambda p: F.when((p >= 1) & (p <= F.length("run")), F.substring("run", p, 1))
    grams = grams.select(F.substring("run", F.col("at"), F.col("n")).alias("word"), side(F.col("at") - 1).alias("before"), side(F.col("at") + F.col("n")).alias("after"))
    counted = grams.groupBy("word", "before", "after").agg(F.count(F.lit(1)).alias("n"))

    def spread(c: str) -> DataFrame:
        """word, n, and the entropy on one side; a run's end counts as a different character each time."""
        by = counted.groupBy("word", c).agg(F.sum("n").alias("n"))
        term = lambda n: n * F.log2(n)
        return by.groupBy("word").agg(F.sum("n").alias("total"), F.sum(F.when(F.col(c).isNull(), 0.0).otherwise(term(F.col("n")))).alias("s")).select("word", "total", (F.log2("total") - F.col("s") / F.col("total")).alias(f"h_{c}"))

    both = spread("before").join(spread("after").drop("total"), "word")
    good = both.filter((F.length("word") == 1) | ((F.col("total") >= least) & (F.col("h_before") >= entropy) & (F.col("h_after") >= entropy)))
    return {r.word: r.total for r in good.orderBy(F.desc("total"), "word").limit(most).collect()}


def _cost(share: float) -> float:
    """A logarithm as a multiple of 2 ** -20, so that sums are exact and equally likely cuts are equal in any order of adding."""
    return round(math.log(share) * (1 << 20)) / (1 << 20)


class Lattice:
    """The likeliest cut of a string into words of a dictionary and single characters."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.costs = {w: _cost(total / n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown = _cost(total * 100)  # of a character that is no word
        # a node is the cost of the word that ends there (of none: infinite) and the nodes behind it
        self.root: dict[str, tuple[float, dict]] = {}
        none: dict = {}
        for word in sorted(self.costs):  # so a word comes after those that it begins with
            nodes = self.root
            for end in range(1, len(word)):
                c, after = nodes.get(word[end - 1]) or (self.cost(word[:end]), none)
                if after is none:
                    after = {}
                    nodes[word[end - 1]] = c, after
                nodes = after
            if word:
                nodes[word[-1]] = self.costs[word], none

    def cost(self, word: str) -> float:
        return self.costs.get(word, self.unknown if len(word) == 1 else math.inf)

    def cut(self, run: str) -> list[str]:
        """Of equally likely cuts the one with the longer last word. From each place only beginnings of words are followed."""
        size, root, longest, unknown = len(run), self.root, self.longest, self.unknown
        best, back = [0.0] + [math.inf] * size, [0] * (size + 1)
        for begin in range(size):
            low, nodes, end = best[begin], root, begin
            for letter in run[begin : begin + longest]:
                node = nodes.get(letter)
                if node is None:
                    break
                end += 1
                c, nodes = node
                if low + c < best[end]:
                    best[end], back[end] = low + c, begin
            if end == begin and low + unknown < best[end + 1]:
                best[end + 1], back[end + 1] = low + unknown, begin
        out, end = [], size
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]


class Cutter:
    """A lattice's cuts of many strings at once, over arrays: the words that begin at each place, told by steps through the dictionary's
    beginnings, and the likeliest path through each piece. Pieces end where no word reaches over, so their paths don't depend on each other;
    of equally likely paths through a piece the one with the longer last word."""

    few = 64  # words that are too few to be worth a step over arrays

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.unknown = _cost(total * 100)
        words = [w for w in counts if w]
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = self._points("".join(words))
        self.letters = np.unique(points)
        places = np.searchsorted(self.letters, points) + 1
        begin = np.cumsum(size) - size
        costs = np.fromiter((_cost(total / counts[w]) for w in words), float, len(words))
        # node 0 is the root; a step from a node with a letter leads to another one
        node, n, self.longest = np.zeros(len(words), np.int64), 1, int(size.max(initial=0))
        keys, ends, of = [], [], np.arange(len(words))
        for k in range(self.longest):
            of = of[size[of] > k]
            steps, at = np.unique(node[of] * (len(self.letters) + 1) + places[begin[of] + k], return_inverse=True)
            node[of] = n + at
            keys.append(steps)
            ends.append(np.full(len(steps), self.unknown if k == 0 else math.inf))
            ends[-1][at[size[of] == k + 1]] = costs[of[size[of] == k + 1]]
            n += len(steps)
        self.cost = np.concatenate([[math.inf], *ends])  # of the word that ends at a node
        keys = np.concatenate([np.zeros(0, np.int64), *keys])
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each in the first free slot from its own on
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # one of those that want it has it
            had = self.keys[slot[left]] == keys[left]
            self.next[slot[left[had]]] = left[had] + 1
            left = left[~had]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node that a letter leads to, 0: none."""
        keys = node.astype(np.int64) * (len(self.letters) + 1) + letter
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.next[slot], 0)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            out[left] = np.where(found == keys[left], self.next[slot[left]], 0)
            left = left[(found != keys[left]) & (found >= 0)]
        return out

    def starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where words begin: the strings lie one after the other, ends has the end of a place's string."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), max(len(self.letters) - 1, 0))
        letter = np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) else np.zeros(n, np.int64)
        letter, ends = letter.astype(np.int32), ends.astype(np.int32)  # places of half the size are gathered faster
        begin, node = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        reach, words = np.arange(1, n + 1, dtype=np.int32), []
        for k in range(max(self.longest, 1)):
            inside = begin + k < ends[begin]
            begin, node = begin[inside], node[inside]
            node = self._step(node, letter[begin + k])
            if k == 0:
                none = begin[node == 0]
                words.append((none, none + 1, np.full(len(none), self.unknown)))
            begin, node = begin[node > 0], node[node > 0]
            cost = self.cost[node]
            word = cost < math.inf
            words.append((begin[word], begin[word] + k + 1, cost[word]))
            reach[begin[word]] = begin[word] + k + 1
            if not len(begin):
                break
        cut = np.append(True, np.maximum.accumulate(reach)[:-1] <= np.arange(1, n))
        cut = np.append(cut, True)
        piece = np.maximum.accumulate(np.where(cut[:-1], np.arange(n, dtype=np.int32), np.int32(0)))
        begin, end, cost = (np.concatenate(x) for x in zip(*words, strict=True))
        far = end - piece[begin]  # ends that are as far into their pieces are settled together
        order = np.argsort(far.astype(np.uint16) if far.max() < 1 << 16 else far, kind="stable")  # shorter words first
        begin, end, cost = begin[order], end[order], cost[order]
        best, back, low = np.full(n + 1, math.inf), np.zeros(n + 1, np.int32), 0
        # a place that begins a piece has cost 0 on the right side; as the end of the piece before it, it is kept apart
        ahead = np.where(cut, 0.0, math.inf)
        for high in np.cumsum(np.bincount(far))[1:].tolist():
            if high - low < self.few:  # what is left are a few long pieces
                break
            b, e = begin[low:high], end[low:high]
            c = ahead[b] + cost[low:high]
            np.minimum.at(best, e, c)
            least = c == best[e]
            back[e[least]] = b[least]  # of several the last, the longest word
            inner = e[~cut[e]]
            ahead[inner] = best[inner]
            low = high
        places = np.unique(np.concatenate([begin[low:], end[low:]]))
        inner, costs, least, of = (~cut[places]).tolist(), ahead[places].tolist(), [math.inf] * len(places), [-1] * len(places)
        for b, e, c in zip(*(np.searchsorted(places, x[low:]).tolist() for x in (begin, end)), cost[low:].tolist(), strict=True):
            c += costs[b]
            if c <= least[e]:
                least[e], of[e] = c, b
                if inner[e]:
                    costs[e] = c
        had = np.array(of, np.int64) >= 0
        back[places[had]] = places[np.array(of, np.int64)[had]]
        path = np.flatnonzero(cut)[1:]
        while len(path):
            path = back[path]
            path = path[~cut[path]]
            cut[path] = True
        return np.flatnonzero(cut[:-1])

    def cut(self, texts: list[list[str]]) -> pa.Array:
        """The words of each list of strings."""
        joined = "".join(r for runs in texts for r in runs)
        sizes = np.fromiter((len(r) for runs in texts for r in runs), np.int64)
        starts = self.starts(points := self._points(joined), np.repeat(np.cumsum(sizes), sizes))
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        ends = np.append(0, np.cumsum(width, dtype=np.int64))[np.append(starts, len(points))]
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(joined.encode("utf-8", "surrogatepass")))
        texts_at = np.cumsum([0, *(sum(map(len, runs)) for runs in texts)])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, texts_at), pa.int32()), words)


def segmented(texts: DataFrame, counts: dict[str, int], column: str = "text", id_col: str = "doc_id", pattern: str = r"[^\W_]+", at_once: int = 1 << 17) -> DataFrame:
    """id_col and words: each run of `pattern` in the lower-cased text cut by the lattice of the dictionary (bounded, so it goes to all tasks).
    Texts are cut together until they have `at_once` characters."""
    shared = texts.sparkSession.sparkContext.broadcast(Cutter(counts))

    def run(batches):
        cutter, runs = shared.value, re.compile(pattern)
        for whole in batches:
            held, low, size = [], 0, 0
            for k in range(whole.num_rows):
                held.append(runs.findall((whole.column(1)[k].as_py() or "").lower()))
                size += sum(map(len, held[-1]))
                if size >= at_once or k == whole.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([whole.column(0).slice(low, len(held)), cutter.cut(held)], names=[id_col, "words"])
                    held, low, size = [], k + 1, 0

    return texts.select(F.col(id_col).cast("long").alias(id_col), F.col(column).cast("string").alias(column)).mapInArrow(run, f"{id_col} long, words array<string>")


def cut_quality(found: DataFrame, true: DataFrame, by: str, id_col: str = "doc_id") -> DataFrame:
    """by, n_true, n_found, n_right, f1 of words compared by their places in the text without spaces. found and true: id_col, words; true also has `by`."""

    def spans(batches):
        """A word as its end and its length, in one number; in time in proportion to the words."""
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                words = batch.column(1)
                flat, at = words.flatten(), np.cumsum([0, *words.value_lengths().fill_null(0).to_pylist()])
                size = pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(np.append(0, size))
                own = ends[1:] - np.repeat(ends[at[:-1]], np.diff(at))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own << 32 | size, pa.int64())), *batch.columns[2:]], names=batch.schema.names)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    t = true.select(id_col, F.col("words").alias("t"), by).mapInArrow(spans, f"{id_col} {kind(true, id_col)}, t array<long>, {by} {kind(true, by)}")
    f = found.select(id_col, F.col("words").alias("f")).mapInArrow(spans, f"{id_col} {kind(found, id_col)}, f array<long>")
    both = t.join(f, id_col)
    sums = both.groupBy(by).agg(F.sum(F.size("t")).alias("n_true"), F.sum(F.size("f")).alias("n_found"), F.sum(F.size(F.array_intersect("t", "f"))).alias("n_right"))
    return sums.withColumn("f1", F.round(2 * F.col("n_right") / (F.col("n_true") + F.col("n_found")), 4))
