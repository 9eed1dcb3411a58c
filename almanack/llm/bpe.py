"""BPE encoding and decoding with a lexicon of the corpus's frequent words as a minimal acyclic transducer.

Words are counted over all documents, and the most frequent ones (`lexicon_words` at most) are merged once, on the driver, and
compiled with their ids (one or several) into a minimal acyclic automaton over bytes: equal suffixes share states, and
counts along the arcs add up to a word's number, which leads to its ids. The automaton is a few flat arrays in a file,
which Spark ships to each executor and every worker maps into memory. Words that it doesn't have are merged by the exact
BPE rule, long ones by a heap of pairs (n log n). A per-worker table, bounded in entries and bytes, keeps recent strings, so
that a word is looked up or merged once in a while, not at each occurrence. New strings are cut, looked up, merged and
packed many at once, as arrays of their bytes: most strings of a corpus are rare. Decoding starts from the ids. The counts
are the only shuffle (one row per distinct word and task); each document is encoded where it is read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
import json
import os
import struct
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, fresh_path, hadoop_path, pieces, small_batches, table, written

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


_LONG = 1 << 16  # letters from which a string is cut into words by itself, which bounds the arrays of a block
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: whether _WORDS takes it as a letter, a number, white space or neither."""
    points = np.delete(np.arange(0x110000, dtype="<u4"), slice(0xD800, 0xE000))  # without surrogates
    every, found = points.tobytes().decode("utf-32-le"), np.full(0x110000, _OTHER, np.uint8)
    for kind, runs in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(runs, every):
            found[points[m.start() : m.end()]] = kind
    return found


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of spans, one span after another."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _blocks(chunks: list[str], letters: int):
    """The strings in lists of so many letters, up to one string more."""
    at = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))) // letters
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(chunks)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield chunks[a:b]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Model:
    """Vocabulary and merges of a word-end BPE tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in (vocab | self.special).items()}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a] << 20 | vocab[b]] = rank, vocab[a + b]
        by = sorted(self.merges.items())
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in by], np.int64), np.array([v[0] for _, v in by], np.int64)
        self.rank_ids, self.none = np.array([v[1] for v in self.merges.values()], np.int64), len(by)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.nothing = max(self.names) + 1  # no token's id
        shown = [(self.names.get(i, "") + " ").encode() for i in range(self.nothing)]
        self.shown, self.shown_size = np.frombuffer(b"".join(shown), np.uint8), np.array([*map(len, shown)], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank is merged, the leftmost first, until there is none."""
        ids: list[int] = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # one of the two has gone into another pair
                continue
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get(ids[x] << 20 | ids[y])):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """merge() of many words at once."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids, count = self.merge_spans(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        return np.split(ids, np.cumsum(count)[:-1])

    def merge_spans(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many spans of text at once: their ids, one span after another, and how many each has.

        In each step every span merges its best pair; spans of over 256 bytes are merged one by one.
        """
        count, parts = np.zeros(len(size), np.int64), []
        for low, high in ((0, 8), (8, 11), (11, 14), (14, 24), (24, 64), (64, 256)):
            rows = np.flatnonzero((size > low) & (size <= high))
            most = (1 << 16) // high
            for k in range(0, len(rows), most):
                part = rows[k : k + most]
                ids, count[part] = self._merge_rows(text, start[part], size[part], high)
                parts.append((part, ids))
        for r in np.flatnonzero(size > 256):
            ids = np.array(self.merge(text[start[r] : start[r] + size[r]].tobytes()), np.int32)
            count[r] = len(ids)
            parts.append((np.array([r]), ids))
        at, out = np.cumsum(count) - count, np.empty(count.sum(), np.int32)
        for part, ids in parts:
            out[_spread(at[part], count[part])] = ids
        return out, count

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the pairs among the sorted merges; ranks of those that aren't there are `none`."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def _merge_rows(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of spans of width bytes at most. A column holds a span's tokens, with `nothing` before and after them, and links to those
        beside each; a pair is its rank and its place in one number, so the least of a column is the pair to merge."""
        n, none = len(size), self.none << 9
        place, column = np.arange(width + 2, dtype=np.int32)[:, None], np.arange(n)
        ids = np.full((width + 2, n), self.nothing, np.int32)
        inside = (place[1:-1] <= size).nonzero()
        ids[1:-1][inside] = self.inner_ids[text[start[inside[1]] + inside[0]]]
        ids[size, column] = self.last_ids[text[start + size - 1]]
        pairs = np.full((width + 2, n), none, np.int32)
        inside = (place[1:-1] < size).nonzero()
        pairs[1:-1][inside] = self._rank(ids[1:-1][inside], ids[2:][inside]) << 9 | inside[0] + 1
        after, before = (place + 1).repeat(n, 1), (place - 1).repeat(n, 1)
        while len(live := np.flatnonzero((best := pairs.min(0)) < none)):
            best = best[live]
            i = best & 511
            h, j = before[i, live], after[i, live]
            k = after[j, live]
            merged = self.rank_ids[best >> 9]
            ids[i, live], ids[j, live], pairs[j, live] = merged, -1, none  # the right part of the pair goes
            after[i, live], before[k, live] = k, i
            pairs[i, live] = self._rank(merged, ids[k, live]) << 9 | i
            pairs[h, live] = self._rank(ids[h, live], merged) << 9 | h
        own = ids[1:-1].T
        left = (own >= 0) & (own < self.nothing)
        return own[left], left.sum(1)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The transducer of words and their ids, as one block of arrays."""
    register: dict[tuple, int] = {}
    counts: list[int] = []
    states: list[tuple[bool, tuple]] = []

    def state(final: bool, arcs: tuple) -> int:
        """The one state with this right language."""
        if (found := register.get((final, arcs))) is None:
            found = register[final, arcs] = len(states)
            states.append((final, arcs))
            counts.append(final + sum(counts[t] for _, t in arcs))
        return found

    ordered = sorted(words)
    path: list[list] = [[False, []]]  # states of the last word that aren't frozen yet: final, arcs

    def freeze(depth: int, labels: bytes) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            path[-1][1].append((labels[len(path) - 1], state(final, tuple(arcs))))

    before = b""
    for w in ordered:
        same = len(os.path.commonprefix((before, w)))
        freeze(same, before)
        path += [[False, []] for _ in w[same:]]
        path[-1][0] = True
        before = w
    freeze(0, before)
    root = state(path[0][0], tuple(path[0][1]))
    keys, targets, skips = [], [], []
    for s, (final, arcs) in enumerate(states):
        skip = int(final)
        for label, t in arcs:
            keys.append(s << 8 | label)
            targets.append(t)
            skips.append(skip)
            skip += counts[t]
    ids = [words[w] for w in ordered]
    out = io.BytesIO()
    arrays = (np.array([root], np.int64), np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.array([f for f, _ in states], np.int64), np.cumsum([0, *map(len, ids)], dtype=np.int64), np.array([x for i in ids for x in i], np.int64))
    out.write(np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays))
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        flat = np.asarray(np.memmap(path, np.int64, "r"))
        edges = np.cumsum([7, *flat[:7]])
        root, self.keys, self.targets, self.skips, self.final, self.at, self.ids = (flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))
        self.root = int(root[0])

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it isn't there."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        return self.find_spans(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)

    def find_spans(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """find() of spans of text; all of them move through the automaton in step."""
        n = len(size)
        number, state = np.zeros(n, np.int64), np.full(n, self.root)
        live = np.flatnonzero(size > 0)
        number[size == 0] = -1
        step = 0
        while len(live) and len(self.keys):
            key = state[live] << 8 | text[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            number[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            number[live] += self.skips[at]
            step += 1
            done = size[live] == step
            ended = live[done]
            number[ended[self.final[state[ended]] == 0]] = -1
            live = live[~done]
        return number if len(self.keys) else np.full(n, -1)

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.at[number] : self.at[number + 1]].tolist()


class Cutter:
    """Cuts texts into the strings between white space, normalised, special tokens apart, and those into words."""

    def __init__(self, special):
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def chunks(self, text: str) -> list[str]:
        """The strings between white space. No word crosses them. A special token is marked by a blank before it, which no other
        string has: lower-cased text may be spelt as one is."""
        parts = self.split.split(text) if self.split and "<|" in text else (text,)
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(f" {part}")
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            # letter by letter, so without the rule for a final sigma
            part = part.replace("Σ", "σ").lower()
            # these four split a str, but are no white space to the tokenizer
            out += _WORDS.findall(part) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
        return out

    def spans(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of strings between white space, none of them a special token: the strings' bytes, each word's start and size there,
        and each string's number of words. As _WORDS would cut, by the kinds of code points."""
        joined = "\n".join([*chunks, ""])
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = _kinds()[code]
        new = np.ones(len(code), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER) | (kind[1:] == _SPACE)
        mark = np.flatnonzero((code == ord("'")) & new)  # 's, 't, 'm, 'd, 're, 've and 'll are words, where no such mark is before
        a, b = code[mark + 1], code[np.minimum(mark + 2, len(code) - 1)]
        two, three = np.isin(a, [*map(ord, "stmd")]), np.isin(a, [*map(ord, "rv")]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        new[mark[two | three] + 1] = False
        new[mark[two] + 2] = new[mark[three] + 3] = True
        at = np.flatnonzero(new)
        word = kind[at] != _SPACE
        ends = np.flatnonzero(~word)
        if len(joined) != len(raw := joined.encode()):
            length = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            at = (np.cumsum(length) - length)[at]
        size = np.diff(at, append=len(raw))
        return np.frombuffer(raw, np.uint8), at[word], size[word], np.diff(ends, prepend=-1) - 1


class Encoder:
    """Encodes texts; keeps the ids of recent strings between white space: up to `most` of them and `most_bytes` in all.

    They stand in two tables, each for half of that: when the newer is full it takes the older one's place, and a string that is met
    again moves to the newer one.
    """

    def __init__(self, model: Model, lexicon: Lexicon, most: int = 150_000, most_bytes: int = 32 << 20):
        self.model, self.lexicon, self.most, self.most_bytes = model, lexicon, most, most_bytes
        self.special = {f" {w}": struct.pack("<I", i) for w, i in model.special.items()}
        self.packed: dict[str, bytes] = dict(self.special)
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.cutter = Cutter(model.special)

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.packed)
        if 2 * (len(self.packed) + len(new)) > self.most or 2 * self.held > self.most_bytes:
            self.older, self.packed, self.held = self.packed, dict(self.special), 0
            new = chunks.difference(self.packed)
        again = set(filter(self.older.__contains__, new))
        self._keep(again, list(map(self.older.__getitem__, again)))
        new = new - again
        long = [c for c in new if len(c) > _LONG] if max(map(len, new), default=0) > _LONG else []
        for c in long:
            self._keep([c], [b"".join(x for part in _blocks(_WORDS.findall(c), 1 << 18) for x in self._packed(part))])
        for part in _blocks(list(new.difference(long)), 1 << 18):
            self._keep(part, self._packed(part))

    def _keep(self, chunks, packed: list[bytes]) -> None:
        self.packed.update(zip(chunks, packed, strict=True))
        self.held += 2 * sum(map(len, chunks)) + sum(map(len, packed))

    def _packed(self, chunks: list[str]) -> list[bytes]:
        """Of each string: ids as little-endian unsigned 32-bit integers."""
        text, start, size, words = self.cutter.spans(chunks)
        number = self.lexicon.find_spans(text, start, size)
        hit, miss = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        first, count = self.lexicon.at[number[hit]], np.empty(len(size), np.int64)
        count[hit] = self.lexicon.at[number[hit] + 1] - first
        merged, count[miss] = self.model.merge_spans(text, start[miss], size[miss])
        end = np.cumsum(count)
        at, ids = end - count, np.empty(end[-1], "<u4")
        ids[_spread(at[hit], count[hit])] = self.lexicon.ids[_spread(first, count[hit])]
        ids[_spread(at[miss], count[miss])] = merged
        flat, ends = ids.tobytes(), (4 * end[np.cumsum(words) - 1]).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905 - the last end begins none

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text: ids as little-endian unsigned 32-bit integers."""
        found = [self.cutter.chunks(t) for t in texts]
        self.learn(set().union(*found))
        return [b"".join(map(self.packed.__getitem__, x)) for x in found]

    def decode(self, packed: bytes) -> bytes:
        """Ids, packed as by encode(), to text in UTF-8: this tokenizer has no decoder, so tokens are joined by spaces."""
        ids, m = np.frombuffer(packed, "<u4"), self.model
        return m.shown[_spread(m.shown_at[ids], m.shown_size[ids])].tobytes()[:-1]


def decode(model: Model, ids) -> str:
    """Ids to text."""
    return " ".join(model.names[i] for i in ids)


def frequent_words(texts: DataFrame, special, most_words: int, most_bytes: int = 64, most_held: int = 50_000) -> list[bytes]:
    """The most frequent words of a text column, counted over all its rows: as many levels of counts as hold most_words words or fewer.

    A task holds at most most_held different strings before it hands its counts on; words of over most_bytes bytes are left out.
    """
    special = tuple(special)

    def count(batches):
        cutter, held = Cutter(special), Counter()

        def rows():
            for c in [c for c in held if len(c) > _LONG]:
                times = held.pop(c)
                for w, n in Counter(_WORDS.findall(c)).items():
                    held[w] += n * times
            for chunks in _blocks([c for c in held if c[0] != " "], 1 << 20):
                yield block(chunks, np.fromiter(map(held.__getitem__, chunks), np.int64, len(chunks)))
            held.clear()

        def block(chunks, times):
            text, start, size, words = cutter.spans(chunks)
            times = np.repeat(times, words)
            fits = size <= most_bytes
            start, size = start[fits], size[fits]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            found = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(text[_spread(start, size)])]).dictionary_encode()
            n = np.zeros(len(found.dictionary), np.int64)
            np.add.at(n, found.indices.to_numpy(), times[fits])
            return pa.RecordBatch.from_arrays([found.dictionary, pa.array(n)], names=["word", "n"])

        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                held.update(cutter.chunks(text or ""))
                if len(held) > most_held:
                    yield from rows()
        yield from rows()

    counted = written(texts.mapInArrow(frees(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # by eighths of powers of two of the count, some hundred rows: only words that are chosen come to the driver
    level = F.floor(8 * F.log2("n"))
    left, least = most_words, None
    for r in sorted(counted.groupBy(level.alias("k")).count().collect(), key=lambda r: -r.k):
        if r["count"] > left:
            break
        left, least = left - r["count"], r.k
    if least is None:
        return []
    return [bytes(r.word) for r in sorted(counted.filter(level >= least).collect(), key=lambda r: (-r.n, bytes(r.word)))]


def lexicon_file(spark, model: Model, words) -> str:
    """Compile a lexicon of words (bytes) and their ids, ship it to all executors, and return its name."""
    distinct = [w for w in dict.fromkeys(words) if w]
    chosen = {w: ids.tolist() for w, ids in zip(distinct, model.merge_many(distinct), strict=True)}
    path = fresh_path(spark, "lexicon") + ".bin"
    fs, p = hadoop_path(spark, path)
    out = fs.create(p)
    try:
        out.write(bytearray(compile_lexicon(chosen)))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


_open: dict[str, Encoder] = {}


def _encode(name: str, spec, with_ids: bool):
    def run(batches):
        if name not in _open:
            _open.clear()
            _open[name] = Encoder(Model(spec.value), Lexicon(SparkFiles.get(name)))
        encoder = _open[name]
        for batch in pieces(batches):
            counts, own, back, lists = [], [], [], []
            texts, group, size = batch.column(1).to_pylist(), [], 0
            for k, text in enumerate(texts, 1):
                group.append(text or "")
                size += len(group[-1])
                if size < 1 << 20 and k < len(texts):
                    continue
                for packed in encoder.encode(group):
                    counts.append(len(packed) // 4)
                    own.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(packed)).hexdigest())
                    if with_ids:
                        lists.append(np.frombuffer(packed, "<u4").astype(np.int32))
                group, size = [], 0
            more = [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", words=None, lexicon_words: int = 100_000, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    tokenizer: path of the tokenizer's file on the driver. A null text counts as empty: no tokens. Ids are carried only, so null
    and repeated ids are fine; other columns are ignored. The lexicon holds the most frequent words of docs, lexicon_words at most, or
    the given words (bytes); it changes the work only, never the ids.
    """
    spark = small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    model = Model(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if words is None:
        words = frequent_words(rows.select("text"), model.special, lexicon_words)
    name, spec = lexicon_file(spark, model, words), spark.sparkContext.broadcast(text)
    return rows.mapInArrow(frees(_encode(name, spec, with_ids)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
