"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, one scan of each text.

Words are runs of letters and digits (ASCII ones lower-cased) and of anything outside ASCII. Each distinct word of the
benchmark gets a number, written as a fixed count of symbols, the first from an alphabet of its own (so that no state of
the automaton has more than 64 ways on, however many words there are); any other word gets a symbol of none. The automaton
runs over these, so a match is a match of whole words. Match positions are mapped back to offsets in the original text for the texts that have any.

The benchmark comes to the driver in blocks of at most `block_bytes` of text and `block_words` words (longer items in
overlapping parts); each block has its automaton and its scan. A benchmark within one block is the normal case: one
scan, no shuffle. Of several blocks, one automaton is alive at a time: between scans, rows go to the shared folder.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, pieces, small_batches, table, written

WINDOW = 10
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NONE = "\x00"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def _codes(words: list[bytes]) -> tuple[dict[bytes, str], int]:
    """Of each word its symbols, and how many a word has. The first symbol's alphabet differs from that of the others."""
    width = 1
    while 64**width < len(words):
        width += 1
    out = {}
    for n, w in enumerate(words):
        digits = [n >> 6 * k & 63 for k in reversed(range(width))]
        out[w] = chr(0x100 + digits[0]) + "".join(chr(0x200 + d) for d in digits[1:])
    return out, width


class Matcher:
    """Automaton over the windows of items: (item_id, text) pairs."""

    def __init__(self, items: list, window: int = WINDOW):
        given = [words_of((text or "").encode()) for _, text in items]
        self.codes, self.width = _codes(list(dict.fromkeys(w for ws in given for w in ws)))
        self.automaton, self.ids, windows = ahocorasick.Automaton(), [i for i, _ in items], {}
        k, size = self.width, window * self.width
        for at, ws in enumerate(given):
            w = "".join([self.codes[x] for x in ws])
            for a in range(0, max(k, len(w) - size + k), k) if w else ():
                windows.setdefault(w[a : a + size], set()).add(at)
        for w, who in windows.items():
            self.automaton.add_word(w, (len(w) // k, tuple(sorted(who))))
        if windows:
            self.automaton.make_automaton()
        self.some, self.none = bool(windows), _NONE * k

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(maximal runs of hit words as (first, past last), items with occurring windows)."""
        if not self.some:
            return [], set()
        get, none, k = self.codes.get, self.none, self.width
        runs, items = [], set()
        for end, (n, who) in self.automaton.iter("".join([get(w, none) for w in words])):
            items.update(who)
            b = end // k + 1
            a = b - n
            while runs and runs[-1][1] >= a:
                a, b = min(a, runs[-1][0]), max(b, runs.pop()[1])
            runs.append((a, b))
        return runs, {self.ids[i] for i in items}


def _joined(runs: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(matcher):
    def run(batches):
        m = matcher.value
        for batch in batches:
            sizes, firsts, lasts, items = [], [], [], []
            for raw, a0, b0, i0 in zip(batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("first", "last", "items")), strict=True):
                words = words_of(raw or b"")
                runs, ids = m.find(words)
                if a0:
                    runs = _joined(runs + list(zip(a0, b0, strict=True)))
                sizes.append(len(words))
                firsts.append([a for a, _ in runs])
                lasts.append([b for _, b in runs])
                items.append(sorted(ids | set(i0 or ()), key=lambda i: (i is None, i or 0)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(lasts, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "n_words", "first", "last", "items"])

    return run


def _offsets(raw: bytes, first: list, last: list) -> list[dict]:
    """Runs of words as code points of the original text."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_FOLD))]
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    return [{"start": int(points[at[x][0]]) - 1, "end": int(points[at[y - 1][1] - 1])} for x, y in zip(first, last, strict=True)]


def _finish(batches):
    for batch in batches:
        spans, digests = [], []
        for raw, a, b, ids in zip(batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("first", "last", "items")), strict=True):
            spans.append(_offsets(raw, a, b) if a else [])
            digests.append(hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest())
        hit = [sum(y - x for x, y in zip(a, b, strict=True)) for a, b in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)]
        n = [len(x) for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(digests), pa.array([h > 0 for h in hit]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column("items")],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
        )


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int = WINDOW, block_words: int = 500_000):
    """(item_id, text) pairs in lists of at most block_bytes of text and block_words words (one part of an item at least).

    An item of more than block_words / 2 words comes in parts that overlap by window - 1 words, so that no window is lost;
    the bound also keeps a block's distinct words below the number of code points.
    """
    out, size, count = [], 0, 0
    step = max(1, block_words // 2)
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of((r[1] or "").encode())
        for k in range(0, max(1, len(words) - window + 1), step):
            part = words[k : k + step + window - 1]
            text = b" ".join(part)
            if out and (size + len(text) > block_bytes or count + len(part) > block_words):
                yield out
                out, size, count = [], 0, 0
            out.append((r[0], text.decode()))
            size, count = size + len(text), count + len(part)
    if out:
        yield out


def _in_turn(rows: DataFrame, found, window: int, step) -> DataFrame:
    """rows through step(rows, broadcast automaton) for each block: one automaton alive at a time."""
    sc = small_batches(rows.sparkSession).sparkContext
    block = next(found, [])
    while True:
        after = next(found, None)
        shared = sc.broadcast(Matcher(block, window))
        rows = step(rows, shared)
        if after is None:
            return rows
        rows = written(rows, "scanned")
        shared.destroy()
        block = after


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 32 << 20, block_words: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (code points of the text), items.

    A window is `window` consecutive words of an item, or a whole item that has fewer. Null and empty texts have no words; an item
    without words has no window; items that repeat count by their ids, those without an id together as one that
    items_sha256 leaves out; rows that repeat are scanned each. An empty benchmark hits nothing. Other columns are ignored.
    """
    none = F.array().cast("array<long>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), none.alias("first"), none.alias("last"), none.alias("items"))
    step = lambda rows, m: rows.select("doc_id", "text", "first", "last", "items").mapInArrow(_scan(m), "doc_id long, text string, n_words long, first array<long>, last array<long>, items array<long>")
    rows = _in_turn(rows, blocks(benchmark, item_id, item_text, block_bytes, window, block_words), window, step)
    return rows.mapInArrow(_finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, items array<long>")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 32 << 20, block_words: int = 500_000) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns. Null and empty texts stay."""

    def keep(matcher):
        def run(batches):
            for batch in pieces(batches):
                raw = batch.column(batch.schema.names.index(text_col)).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not matcher.value.find(words_of(x or b""))[0] for x in raw], pa.bool_()))

        return run

    return _in_turn(docs, blocks(benchmark, item_id, item_text, block_bytes, window, block_words), window, lambda rows, m: rows.mapInArrow(frees(keep(m)), docs.schema))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document scanned for passages of the benchmark."""
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
