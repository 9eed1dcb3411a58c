"""Removal of repeated byte strings across documents: suffix buckets refined by the bucket identifiers of later offsets.

A string of 50 bytes is removed where an earlier document has it too. Suffixes go into buckets, and only buckets that
two documents hold are refined:

1. Each string of 50 bytes has 31 inner offsets at which 20 bytes fit; the least of their 20-byte identifiers (48 bits of
   it) is the string's key. Keys only select: equal strings have equal keys. Strings that start at successive offsets mostly
   share a key: such a run (31 starts at most) is a *piece*, of at most 80 bytes. Pieces whose key no other document holds
   end here.
2. Pieces whose key is shared are named by 128 bits of their bytes (n names: n * n / 2**129 expected errors), each name once
   a chunk. A piece that an earlier document has whole is settled by that.
3. Of the rest, pieces whose key has several different pieces are sent, with their bytes, to the owner of the key. The
   owner sorts their suffixes by bucket-pointer refinement: the first buckets are those of 8-byte grams; a bucket is
   refined by sorting its suffixes on the bucket pointers found at a later offset, 8 bytes on, then 16, then 18, where each
   sort reads the pointers that the sort before has updated, so depth goes 8, 16, 32, 50. Suffixes alone in their bucket
   leave it. What is in one bucket at depth 50 has the same 50 bytes. The least document of each bucket keeps its string.
4. Keys with more than `hot` pieces aren't gathered: each start of theirs is named by itself (128 bits of its 50 bytes), and
   each chunk asks about each name once.

Documents lie in chunks, which are ranges of doc_id of about `chunk_bytes` of text, so a smaller chunk holds smaller doc_ids
only. A passage in a third of all documents makes as many rows as there are chunks for each of its starts, not as there
are documents. Texts are shuffled once, compressed one by one; the later steps reuse that exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Length of a repeated string, of the first buckets, and the offsets within a string at which a first bucket fits.
DEPTH, GRAM = 50, 20
INNER = DEPTH - GRAM + 1
SPAN = DEPTH + INNER - 1
#: Refinements: from buckets of the first depth, by those so many bytes on.
STEPS = ((8, 8), (16, 16), (32, 18))
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _grams(raw: bytes) -> np.ndarray:
    """Identifiers of 20 bytes from each offset, as words at 0, 8 and 12."""
    v = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    x = v[: 8 - GRAM] * _A
    x += v[8 : 16 - GRAM] * _C
    x += v[GRAM - 8 :] * _B
    return x


def _names(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two numbers, of rows of 64-bit words."""
    out = []
    for first, by in ((_A, _B), (_C, _D)):
        x = words[0] * first
        for w in words[1:]:
            x ^= x >> np.uint64(31)
            x = (x + w) * by
        x ^= x >> np.uint64(29)
        x *= first
        out.append(x ^ (x >> np.uint64(32)))
    return out[0], out[1]


#: Rows that are worked on at a time, so that a chunk's temporary arrays stay small.
_BLOCK = 1 << 17


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, count of them, in one array."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


class Pieces:
    """The pieces of a chunk's documents: texts in order of ordinal (documents with equal doc_id share one)."""

    def __init__(self, texts: list[bytes], ordinals: list[int]):
        keys, firsts, counts, docs = [], [], [], []
        self.texts = texts
        for number, raw in enumerate(texts):
            if len(raw) < DEPTH:
                continue
            key = _sliding_min(_grams(raw), INNER)
            starts = np.flatnonzero(key[1:] != key[:-1])
            starts = np.concatenate((np.zeros(1, np.int64), starts + 1))
            lengths = np.diff(starts, append=len(key))
            if lengths.max() > INNER:  # periodic text: cut long runs
                more = (lengths + INNER - 1) // INNER
                ends = np.repeat(starts + lengths, more)
                starts = np.repeat(starts, more) + INNER * _spread(np.zeros(len(more), np.int64), more)
                lengths = np.minimum(ends - starts, INNER)
            keys.append(key[starts] >> np.uint64(16))
            firsts.append(starts)
            counts.append(lengths)
            docs.append(np.full(len(starts), number))
        cat = lambda x, t: np.concatenate(x).astype(t, copy=False) if x else np.empty(0, t)
        self.key, self.first, self.count, self.doc = cat(keys, np.uint64), cat(firsts, np.int64), cat(counts, np.int64), cat(docs, np.int64)
        self.ordinal = np.asarray(ordinals, np.int64)

    def order(self) -> np.ndarray:
        return self.ordinal[self.doc]

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's bytes (with room for a last span), and where in them the given pieces start."""
        size = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        begin = np.cumsum(size) - size
        return np.frombuffer(b"".join([*self.texts, bytes(SPAN)]), np.uint8), begin[self.doc[rows]] + self.first[rows]

    def spans(self, rows: np.ndarray) -> pa.Array:
        """The bytes of whole pieces."""
        raw, at = self.places(rows)
        size = self.count[rows] + DEPTH - 1
        inside = np.arange(SPAN) < size[:, None]
        flat = np.lib.stride_tricks.sliding_window_view(raw, SPAN)[at][inside]
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def span_names(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of whole pieces."""
        raw, at = self.places(rows)
        every = np.lib.stride_tricks.sliding_window_view(raw, SPAN)
        x, y = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint64)
        for k in range(0, len(rows), _BLOCK):
            part = slice(k, k + _BLOCK)
            size = self.count[rows[part]] + DEPTH - 1
            wide = every[at[part]] * (np.arange(SPAN) < size[:, None])
            x[part], y[part] = _names([size.astype(np.uint64), *np.ascontiguousarray(wide.astype(np.uint8, copy=False)).view("<u8").T])
        return x, y

    def start_names(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each start in pieces: the place of its piece among rows, 128-bit name of its 50 bytes."""
        n = self.count[rows]
        raw, place = self.places(rows)
        of, at = np.repeat(np.arange(len(rows)), n), _spread(place, n)
        v = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        x, y = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        for k in range(0, len(at), _BLOCK):
            part = at[k : k + _BLOCK]
            x[k : k + _BLOCK], y[k : k + _BLOCK] = _names([v[part + i] for i in (0, 8, 16, 24, 32, 40, 42)])
        return of, x, y


def _distinct(x: np.ndarray, y: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (x, y, by) and which of these are the first of their (x, y)."""
    at = np.lexsort((*reversed(by), y, x))
    return at, np.concatenate(([True], (x[at][1:] != x[at][:-1]) | (y[at][1:] != y[at][:-1]))) if len(at) else np.empty(0, bool)


def _held(x: np.ndarray, y: np.ndarray, told_x: np.ndarray, told_y: np.ndarray) -> np.ndarray:
    """Which of the names (x, y) are told."""
    both_x, both_y = np.concatenate((told_x, x)), np.concatenate((told_y, y))
    at, new = _distinct(both_x, both_y, np.arange(len(both_x)) >= len(told_x))
    first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else at
    out = np.empty(len(at), bool)
    out[at] = first < len(told_x)
    return out[len(told_x) :]


def _pointers(key: np.ndarray) -> np.ndarray:
    """Bucket pointers: of each key the place of its bucket's first member in sorted order."""
    by = np.argsort(key, kind="stable")
    ordered = key[by]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    out = np.empty(len(key), np.int64)
    out[by] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return out


def refined(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bucket pointers at depth 50 of all starts of spans: rows of SPAN bytes, size of each. -1 where a start is alone in its bucket.

    Bucket-pointer refinement over all offsets at once: buckets of 8-byte grams, then each is sorted on the pointers at a
    later offset, which are those of the last sort.
    """
    n = len(rows)
    wide = np.zeros((n, SPAN + 8), np.uint8)
    wide[:, :SPAN] = rows
    gram = np.lib.stride_tricks.sliding_window_view(wide, 8, axis=1)[:, : SPAN - 7]
    gram = np.ascontiguousarray(gram).view(">u8")[..., 0].astype(np.uint64)
    depth, pointer = 8, np.full((n, SPAN), -1, np.int64)
    live = np.arange(SPAN - 7) + 8 <= size[:, None]
    at = np.nonzero(live)
    pointer[at] = _pointers(gram[at])
    for depth, on in STEPS:
        deep = depth + on
        ok = np.zeros((n, SPAN), bool)
        ok[:, : SPAN - deep + 1] = np.arange(SPAN - deep + 1) + deep <= size[:, None]
        # a suffix alone in its bucket, or with one alone further on, is alone from here on
        count = np.bincount(pointer[pointer >= 0], minlength=1) if (pointer >= 0).any() else np.zeros(1, np.int64)
        alone = (pointer < 0) | (count[np.maximum(pointer, 0)] == 1)
        later = np.full((n, SPAN), -1, np.int64)
        later[:, : SPAN - on] = np.where(alone[:, on:], -1, pointer[:, on:])
        at = np.nonzero(ok & ~alone & (later >= 0))
        key = pointer[at] << 32 | later[at]
        pointer = np.full((n, SPAN), -1, np.int64)
        if len(key):
            pointer[at] = _pointers(key)
    out = pointer[:, :INNER]
    count = np.bincount(out[out >= 0], minlength=1) if (out >= 0).any() else np.zeros(1, np.int64)
    return np.where((out >= 0) & (count[np.maximum(out, 0)] > 1), out, -1)


def settle(key: np.ndarray, order: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Of each piece a mask of its starts whose 50 bytes a piece of less order has too. Pieces with equal bytes count once."""
    coded = spans.dictionary_encode()
    code, values = coded.indices.to_numpy(), coded.dictionary
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, code, order)
    size = np.diff(np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)).astype(np.int64)
    whole = (np.int64(1) << (size - DEPTH + 1)) - 1
    mask = np.where(least[code] < order, whole[code], 0)
    # the rest: the first holder of each span, where its key has several spans
    own = np.zeros(len(values), np.uint64)
    own[code] = key
    _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(count[inverse] > 1)
    if not len(open_):
        return mask
    flat = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    begin = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)[:-1].astype(np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(np.append(flat, np.zeros(SPAN, np.uint8)), SPAN)[begin[open_]]
    pointer = refined(rows, size[open_])
    span, start = np.nonzero(pointer >= 0)
    bucket = pointer[span, start]
    first = np.full(int(bucket.max()) + 1 if len(bucket) else 1, np.iinfo(np.int64).max)
    np.minimum.at(first, bucket, least[open_][span])
    again = first[bucket] < least[open_][span]
    found = np.zeros(len(values), np.int64)
    np.bitwise_or.at(found, open_[span[again]], np.int64(1) << start[again])
    return np.where(mask == 0, found[code], mask)


def _first_order(names: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, their least and greatest order, and each row's place among the distinct. order is ascending."""
    if not len(names):
        e = np.empty(0, np.int64)
        return names, e, e, e
    by = np.argsort(names, kind="stable")
    new = np.concatenate(([True], names[by][1:] != names[by][:-1]))
    edge = np.flatnonzero(new)
    inverse = np.empty(len(names), np.int64)
    inverse[by] = np.cumsum(new) - 1
    return names[by][edge], order[by[edge]], order[by[np.append(edge[1:], len(by)) - 1]], inverse


def _among(x: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which of x are told; told is sorted."""
    if not len(told):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(told, x), len(told) - 1)
    return told[at] == x


class Chunk:
    """One chunk's part in each step.

    Documents with null doc_id neither give nor lose a repeat; documents with equal doc_id don't count against each
    other; a null text is an empty one.
    """

    def __init__(self, doc_ids: list, texts: list[bytes]):
        by = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))
        self.doc_ids, self.texts = [doc_ids[i] for i in by], [texts[i] for i in by]
        ordinals, last = [], -1
        for i, d in enumerate(self.doc_ids):
            last += i == 0 or d is None or d != self.doc_ids[i - 1]
            ordinals.append(last)
        known = [x if d is not None else b"" for d, x in zip(self.doc_ids, self.texts, strict=True)]
        self.pieces = Pieces(known, ordinals)
        self.order = self.pieces.order()

    def ask_keys(self) -> np.ndarray:
        """Keys of the chunk, each once."""
        return np.unique(self.pieces.key)

    def ask_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the chunk, each once, and how many pieces have each."""
        return np.unique(self.pieces.key, return_counts=True)

    def shared(self, told: np.ndarray, told_hot: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces whose key several documents hold, here or (told) elsewhere: those of other keys, those of hot ones."""
        uniq, least, most, inverse = _first_order(self.pieces.key, self.order)
        if not len(uniq):
            return inverse, inverse
        very = _among(uniq, told_hot) | (np.bincount(inverse, minlength=len(uniq)) > hot)
        several = (least < most) | _among(uniq, told) | _among(uniq, told_hot)
        return np.flatnonzero((several & ~very)[inverse]), np.flatnonzero((several & very)[inverse])

    def first_spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names of pieces (two numbers), which are the first in the chunk of their name, and which come after a document with the same."""
        x, y = self.pieces.span_names(rows)
        order = self.order[rows]
        at, new = _distinct(x, y, order)
        least = np.empty(len(rows), np.int64)
        least[at] = order[at][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else 0
        first = np.zeros(len(rows), bool)
        first[at[new]] = True
        return x, y, first, least < order

    def hot_starts(self, rows: np.ndarray):
        """Pieces of hot keys: different spans once. (which of rows holds each, each row's span, (span, x, y) of each start)."""
        x, y = self.pieces.span_names(rows)
        at, new = _distinct(x, y, self.order[rows])
        code = np.empty(len(rows), np.int64)
        code[at] = np.cumsum(new) - 1
        return at[new], code, self.pieces.start_names(rows[at[new]])

    def hot_masks(self, very: np.ndarray, told: tuple) -> np.ndarray:
        """Of pieces of hot keys a mask of the starts whose 50 bytes an earlier document has, here or (told names) in an earlier chunk."""
        p, out = self.pieces, np.zeros(len(very), np.int64)
        if not len(very):
            return out
        holder, code, (span, x, y) = self.hot_starts(very)
        order = self.order[very]
        at, new = _distinct(x, y, order[holder][span])
        least = np.empty(len(x), np.int64)
        least[at] = order[holder][span][at][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        least[_held(x, y, *told)] = -1
        begin = np.append(0, np.cumsum(p.count[very[holder]]))
        for k in range(0, len(very), _BLOCK // 16):
            part = np.arange(k, min(k + _BLOCK // 16, len(very)))
            n = p.count[very[part]]
            hit = least[_spread(begin[code[part]], n)] < np.repeat(order[part], n)
            np.bitwise_or.at(out, np.repeat(part, n)[hit], np.int64(1) << _spread(np.zeros(len(n), np.int64), n)[hit])
        return out

    def removed(self, no: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        """By document, in ascending doc_id, a mask of the bytes to remove. no, mask: pieces and their starts that are repeats."""
        p = self.pieces
        docs, ats = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(0, len(no), _BLOCK // 16):
            part = no[k : k + _BLOCK // 16]
            row, start = np.nonzero((mask[k : k + _BLOCK // 16, None] >> np.arange(INNER)) & 1)
            docs.append(p.doc[part[row]])
            ats.append(p.first[part[row]] + start)
        doc, at = np.concatenate(docs), np.concatenate(ats)
        by = np.argsort(doc, kind="stable")
        doc, at = doc[by], at[by]
        edge = np.searchsorted(doc, np.arange(len(self.texts) + 1))
        out = []
        for i, raw in enumerate(self.texts):
            a = np.unique(at[edge[i] : edge[i + 1]])
            step = np.zeros(len(raw) + 1, np.int32)
            step[a] += 1
            step[a + DEPTH] -= 1
            out.append(np.cumsum(step[:-1]) > 0)
        return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _chunk(t: pa.Table) -> Chunk:
    unpack = zstandard.ZstdDecompressor().decompress
    return Chunk(t.column("doc_id").to_pylist(), [unpack(x) if x else b"" for x in t.column("text").to_pylist()])


def _of(t: pa.Table, name: str, dtype=np.int64) -> np.ndarray:
    return t.column(name).cast(pa.int64()).to_numpy().view(dtype) if len(t) else np.empty(0, dtype)


def _step_keys(key, docs):
    keys, n = _chunk(docs).ask_keys()
    return pa.table({"chunk": pa.array(np.full(len(keys), key[0].as_py(), np.int64)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int32))})


NAMED = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])
SENT = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("no", pa.int32()), ("place", pa.int32()), ("key", pa.int64()), ("span", pa.binary())])
TOLD = pa.schema([("chunk", pa.int64()), ("no", pa.int32()), ("mask", pa.int32()), ("settled", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _table(schema: pa.Schema, n: int, **columns) -> pa.Table:
    wide = lambda v: np.full(n, v, np.int64) if np.isscalar(v) else v.view(np.int64)
    return pa.table([v if isinstance(v, pa.Array) else pa.array(wide(v)).cast(schema.field(k).type) for k, v in columns.items()], schema=schema)


def _step_names(hot: int):
    """Names of the chunk's shared pieces, and of the starts of its hot ones (a name is its own key), each once."""

    def step(key, docs, told):
        chunk = _chunk(docs)
        cold, very = chunk.shared(*_kinds(told)[:2], hot)
        x, y, first, _ = chunk.first_spans(cold)
        _, _, (_, sx, sy) = chunk.hot_starts(very)
        at, new = _distinct(sx, sy)
        sx, sy = sx[at[new]], sy[at[new]]
        n = int(first.sum()) + len(sx)
        return _table(NAMED, n, chunk=key[0].as_py(), key=np.concatenate((chunk.pieces.key[cold][first], sx)), x=np.concatenate((x[first], sx)), y=np.concatenate((y[first], sy)))

    return step


def _kinds(told: pa.Table) -> tuple:
    """What a chunk was told: keys (kind 0), hot keys (1), names that an earlier chunk has (2), names whose key has several (3)."""
    kind, a, b = _of(told, "kind"), _of(told, "a", np.uint64), _of(told, "b", np.uint64)
    return np.sort(a[kind == 0]), np.sort(a[kind == 1]), (a[kind == 2], b[kind == 2]), (a[kind == 3], b[kind == 3])


def _resolved(chunk: Chunk, told: pa.Table, hot: int) -> tuple:
    """(pieces that go whole, pieces to refine, pieces of hot keys, names that an earlier chunk has)."""
    keys, hot_keys, earlier, several = _kinds(told)
    cold, very = chunk.shared(keys, hot_keys, hot)
    x, y, first, after = chunk.first_spans(cold)
    whole = after | _held(x, y, *earlier)
    # a key that only this chunk holds is told nowhere: its pieces are refined if they differ
    key = chunk.pieces.key[cold]
    uniq, inverse = np.unique(key, return_inverse=True)
    differs = np.bincount(inverse, weights=first, minlength=len(uniq))[inverse] > 1 if len(uniq) else np.empty(0, bool)
    return cold[whole], cold[~whole & (differs | _held(x, y, *several))], very, earlier


def _step_send(slots: int, hot: int):
    """Pieces to refine with their bytes, to their key's owner, and one row (no = -1) with what is settled already, which the owner hands back."""

    def step(key, docs, told):
        chunk = _chunk(docs)
        p = chunk.pieces
        whole, rows, very, earlier = _resolved(chunk, told, hot)
        masks = chunk.hot_masks(very, earlier)
        no = np.concatenate((whole, very[masks > 0])).astype("<i4")
        mask = np.concatenate(((np.int64(1) << p.count[whole]) - 1, masks[masks > 0])).astype("<i4")
        settled = zstandard.ZstdCompressor(level=3).compress(no.tobytes() + mask.tobytes())
        one = lambda a, v: np.concatenate((a.astype(np.int64, copy=False), [v]))
        slot = (((p.key[rows] * _D) >> np.uint64(16)) % np.uint64(slots)).astype(np.int64)
        me = key[0].as_py()
        return _table(SENT, len(rows) + 1, slot=one(slot, me % slots), chunk=me, no=one(rows, -1), place=one(chunk.order[rows], 0), key=one(p.key[rows].view(np.int64), 0), span=pa.concat_arrays([p.spans(rows), pa.array([settled], pa.binary())]))

    return step


def _step_settle(key, sent):
    no, chunk = _of(sent, "no"), _of(sent, "chunk")
    back = sent.filter(pa.array(no < 0))
    open_ = sent.filter(pa.array(no >= 0))
    n = len(back)
    out = [_table(TOLD, n, chunk=_of(back, "chunk"), no=-1, mask=0, settled=back.column("span").combine_chunks())] if n else []
    if len(open_):
        chunk = _of(open_, "chunk")
        mask = settle(_of(open_, "key", np.uint64), chunk << 32 | _of(open_, "place"), open_.column("span").combine_chunks())
        rows = np.flatnonzero(mask)
        out.append(_table(TOLD, len(rows), chunk=chunk[rows], no=_of(open_, "no")[rows], mask=mask[rows], settled=pa.nulls(len(rows), pa.binary())))
    return pa.concat_tables(out)


def _final(with_kept: bool):
    def step(key, docs, told):
        chunk = _chunk(docs)
        no, mask = _of(told, "no"), _of(told, "mask")
        no, mask = [no[no >= 0]], [mask[no >= 0]]
        for blob in told.column("settled").to_pylist():
            if blob:
                pair = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i4").reshape(2, -1).astype(np.int64)
                no.append(pair[0])
                mask.append(pair[1])
        masks_of = chunk.removed(np.concatenate(no), np.concatenate(mask))
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for d, raw, mask in zip(chunk.doc_ids, chunk.texts, masks_of, strict=True):
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes() if mask.any() else raw
            row = d, len(raw), int(mask.sum()), int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) and mask[0])), hashlib.sha256(kept).hexdigest(), kept if with_kept else None
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return step


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int, int]:
    """(doc_id, text, chunk), chunks, bytes: chunks are ranges of doc_id of about chunk_bytes of text, and at least as many as shuffle partitions.

    The bounds are exact-to-1/10,000 quantiles over all doc_ids (one number per chunk on the driver).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-total // chunk_bytes))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000 + 10 * n)).first()[0] if n > 1 else []
    bounds = np.unique(np.array(bounds or [], np.int64))

    def place(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
            texts = [pack(x) if x else None for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), pa.array(at, pa.int64())], names=["doc_id", "text", "chunk"])

    return rows.mapInArrow(place, "doc_id long, text binary, chunk long"), n, total


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20, slot_bytes: int = 1 << 20, hot: int = 4096, with_kept: bool = True) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a document with a smaller id.

    Returns a row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the
    remaining bytes; null unless with_kept). A null text counts as empty; a row with a null id loses nothing and makes no
    other row lose anything; rows that share an id don't count against each other. Other columns are ignored. slot_bytes: text
    for each owner of keys; hot: pieces of one key beyond which it isn't gathered. Neither changes the result.
    """
    at, n, total = chunked(docs, id_col, text_col, chunk_bytes)
    by_chunk = at.repartition(n, "chunk").groupBy("chunk")
    asked = by_chunk.applyInArrow(_step_keys, "chunk long, key long, n int")
    w = Window.partitionBy("key")
    seen = asked.withColumns({"chunks": F.count(F.lit(1)).over(w), "pieces": F.sum("n").over(w)}).filter("chunks > 1")
    none = F.lit(0).cast("long")
    keys = seen.select("chunk", (F.col("pieces") > hot).cast("int").alias("kind"), F.col("key").alias("a"), none.alias("b"))
    named = by_chunk.cogroup(keys.groupBy("chunk")).applyInArrow(_step_names(hot), _ddl(NAMED))
    # hot keys aside, a key has no more than `hot` rows, and a name no more than there are chunks
    found = named.withColumns({"several": F.min("x").over(w) != F.max("x").over(w), "earlier": F.min("chunk").over(Window.partitionBy("key", "x", "y")) < F.col("chunk")})
    names = found.filter("several or earlier").select("chunk", F.when(F.col("earlier"), 2).otherwise(3).alias("kind"), F.col("x").alias("a"), F.col("y").alias("b"))
    slots = max(n, -(-total // slot_bytes))
    sent = by_chunk.cogroup(keys.unionByName(names).groupBy("chunk")).applyInArrow(_step_send(slots, hot), _ddl(SENT))
    masks = sent.groupBy("slot").applyInArrow(_step_settle, _ddl(TOLD))
    return by_chunk.cogroup(masks.groupBy("chunk")).applyInArrow(_final(with_kept), SCHEMA)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The repeats removed from every document, in figures."""
    from .common import table

    return dedup(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")
