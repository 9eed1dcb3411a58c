"""A persisted text index: postings in blocks by term and range of ids, with what bounds a block's scores, and a top-k that skips blocks.

Layout below a path, a folder a generation:

* postings/gen=g: a row a block: term, range_no, n, max_tf, min_dl, min_day, max_day and, by id, docs, days, tfs, dls. Each
  file is sorted by term, so a query's terms are found by the statistics of row groups and pages. Texts are shuffled once, by
  range; a range's blocks are made whole by the task that has its texts, so postings aren't shuffled, nor are they by compact();
* ranges/gen=g: range_no, n_docs, sum_dl and a fingerprint of the ranges that the generation holds. It is written last and
  makes the generation visible; of a range the newest generation counts.

A block holds the postings of one term in one range of `width` ids, so at most `width` of them. Frequencies are weighted by
column when indexed; lengths are those of all columns. As a score grows with the frequency and falls with the length, a
block's max_tf and min_dl bound its scores under any later corpus statistics.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segment import CJK, Lattice

K1, B = 1.2, 0.75
#: Bounds of a query: terms and characters.
MOST_TERMS, MOST_CHARACTERS = 32, 1024
_WORD = re.compile(r"[^\W_]+")
_PART = "term string, range_no long, n int, max_tf double, min_dl int, min_day int, max_day int, sum_dl long, print decimal(38,0), docs array<long>, days array<int>, tfs array<double>, dls array<int>"
#: Blocks of a page at most: what a search reads of a file beside its terms' own blocks.
_PAGE = 1000
#: Entries whose texts are taken apart at once; ranges stay whole.
_AT_ONCE = 256
_CJK = re.compile(CJK)


def words_of(text: str, lattice: Lattice | None = None) -> list[str]:
    """Runs of letters and digits of a lower-cased text; with a lattice, CJK within them is cut into its words."""
    words = _WORD.findall(text)
    if lattice is None or not _CJK.search(text):
        return words
    return [x for w in words for part in (re.split(f"({CJK}+)", w) if _CJK.search(w) else (w,)) if part for x in (lattice.cut(part) if _CJK.match(part) else (part,))]


def query_terms(text: str, lattice: Lattice | None = None) -> list[str]:
    """The different terms of a query, of its first 1,024 characters the first 32."""
    return list(dict.fromkeys(words_of(text[:MOST_CHARACTERS].lower(), lattice)))[:MOST_TERMS]


def _number(width: int):
    """The range of an id."""
    return F.expr(f"(cast(doc_id as long) - pmod(cast(doc_id as long), {width}L)) div {width}L")


_letters: list = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits, as _WORD has them."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][np.minimum(points, 0x10FFFF)]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and the number of the text that each is of: words_of() without a lattice, told by the bytes of UTF-8."""
    n, blank = len(texts), (pa.array([], pa.string()), np.zeros(0, np.int64))
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    if ends[-1] == ends[0]:
        return blank
    data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    last, own = len(data) - 1, _is_letter(np.arange(128))
    held = np.append(own, np.zeros(128, bool))[data]
    at = np.flatnonzero(data >= 0xC0)  # first bytes of the other characters
    first, more = data[at].astype(np.int32), [data[np.minimum(at + k, last)].astype(np.int32) & 0x3F for k in range(4)]
    two, three = (first & 0x1F) << 6 | more[1], (first & 0xF) << 12 | more[1] << 6 | more[2]
    points = np.where(first < 0xE0, two, np.where(first < 0xF0, three, (first & 7) << 18 | more[1] << 12 | more[2] << 6 | more[3]))
    size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
    letter = _is_letter(points)
    for k in range(4):
        held[np.minimum(at[letter & (size > k)] + k, last)] = True
    begins = np.zeros(len(data) + 1, bool)
    begins[ends] = True
    starts = np.flatnonzero(held & (begins[:-1] | ~np.append(False, held[:-1])))
    if not len(starts):
        return blank
    before = np.cumsum(held)  # bytes of words so far
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(before[starts] - 1, before[-1]).astype(np.int32)), pa.py_buffer(data[held]))
    return words, np.searchsorted(ends, starts, "right") - 1


def _blocks(batch: pa.RecordBatch, weights: list[float], width: int, lattice: Lattice | None) -> pa.RecordBatch:
    """The blocks of whole ranges, given by id. Each entry is also one of the empty term."""
    n, kinds = batch.num_rows, len(weights) + 1
    words, rows, kind = [pa.array([""] * n, pa.string())], [np.arange(n)], [np.full(n, kinds - 1)]
    for k in range(len(weights)):
        texts = pc.fill_null(batch.column(2 + k).cast(pa.string()), "")
        if lattice is None:
            found, of = _words(texts)
        else:
            cut = [words_of(x, lattice) for x in texts.to_pylist()]
            found, of = pa.array([w for ws in cut for w in ws], pa.string()), np.repeat(np.arange(n), [len(ws) for ws in cut])
        words.append(found), rows.append(of), kind.append(np.full(len(of), k))
    coded, row = pa.concat_arrays(words).dictionary_encode(), np.concatenate(rows)
    terms, ids = coded.dictionary, batch.column(0).to_numpy()
    numbers, of_range = np.unique(ids // width, return_inverse=True)
    lengths = (np.bincount(row, minlength=n) - 1).astype(np.int32)
    # in one number: range, term, entry and column; equal ones are counted
    key = np.sort(((of_range[row] * len(terms) + coded.indices.to_numpy()) * n + row) * kinds + np.concatenate(kind))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    values = np.append(weights, 0.0)[key[starts] % kinds] * np.diff(np.append(starts, len(key)))
    key = key[starts] // kinds
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tfs, key = np.add.reduceat(values, starts), key[starts]
    row, key = key % n, key // n
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends, key = np.append(starts, len(row)), key[starts]
    code, number = key % len(terms), numbers[key // len(terms)]
    dls = lengths[row]
    day = batch.column(1).cast(pa.int32())
    known, days = ~day.is_null().to_numpy(zero_copy_only=False)[row], pc.fill_null(day, 0).to_numpy()[row]
    none = ~np.logical_or.reduceat(known, starts)
    whole = np.flatnonzero(code == coded.indices[0].as_py())  # the blocks of the empty term, one a range
    sums, prints = [None] * len(starts), [None] * len(starts)
    hashes = batch.column(1 + kinds).to_pylist() if batch.num_columns > 1 + kinds else None
    for b in whole.tolist():
        sums[b] = int(dls[ends[b] : ends[b + 1]].sum(dtype=np.int64))
        prints[b] = sum(hashes[r] for r in row[ends[b] : ends[b + 1]]) if hashes else None
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(ids[row], pa.int64()), pa.array(days, pa.int32(), mask=~known), pa.array(tfs), pa.array(dls))]
    of_days = [pa.array(f.reduceat(np.where(known, days, far), starts), pa.int32(), mask=none) for f, far in ((np.minimum, 2**31 - 1), (np.maximum, -(2**31)))]
    heads = [pa.array(np.diff(ends), pa.int32()), pa.array(np.maximum.reduceat(tfs, starts)), pa.array(np.minimum.reduceat(dls, starts)), *of_days, pa.array(sums, pa.int64()), pa.array(prints, pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays([terms.take(pa.array(code)), pa.array(number, pa.int64()), *heads, *lists], names=[c.split()[0] for c in _PART.split(", ")])


def _counted(weights: list[float], width: int, dictionary=None):
    """Blocks of entries in order of their ids, all those of a range in one task: doc_id, day, texts and, if given, a hash of the entry."""

    def run(batches):
        lattice = Lattice(dictionary.value) if dictionary else None

        def made(held):
            (batch,) = pa.Table.from_batches(held).combine_chunks().to_batches()
            number = batch.column(0).to_numpy() // width
            cuts, at = np.append(np.flatnonzero(np.diff(number)) + 1, len(number)), 0
            while at < len(number):
                end = int(cuts[np.searchsorted(cuts, min(at + _AT_ONCE, len(number)))])
                yield _blocks(batch.slice(at, end - at), weights, width, lattice)
                at = end

        held, last = [], None  # the last range so far
        for whole in batches:
            if not whole.num_rows:
                continue
            number = whole.column(0).to_numpy() // width
            if held and number[-1] != last:
                at = int(np.searchsorted(number, number[-1]))
                yield from made([*held, whole.slice(0, at)])
                held, whole = [], whole.slice(at)
            held, last = [*held, whole], number[-1]
        if held:
            yield from made(held)

    return run


class TextIndex:
    """The index below a path. Ids are whole numbers, one row each; rows without an id can't be indexed and are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # writing ----------------------------------------------------------------------------------------------------------
    def _generations(self) -> list[int]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ranges")
        done = [s.getPath() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        marked = lambda x: self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))
        return sorted(int(x.getName()[4:]) for x in done if x.getName().startswith("gen=") and marked(x))

    def _settings(self) -> dict:
        (row,) = self.spark.read.text(f"{self.path}/settings").collect()
        return json.loads(row.value)

    def _hash(self, settings: dict):
        """A number for an entry's content."""
        day = [settings["day"]] if settings["day"] else []
        return F.xxhash64("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*settings["columns"], *day]))

    def _prints(self, entries: DataFrame, settings: dict) -> DataFrame:
        """range_no, print: a sum of the entries' hashes, in any order."""
        own = entries.filter("doc_id is not null")
        return own.groupBy(_number(settings["width"]).alias("range_no")).agg(F.sum(self._hash(settings).cast("decimal(38,0)")).alias("print"))

    def _write(self, entries: DataFrame, gen: int, settings: dict, ranges: DataFrame | None) -> None:
        columns, width, day = settings["columns"], settings["width"], settings["day"]
        own = entries.filter(F.col("doc_id").isNotNull())
        days = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) if day else F.lit(None)
        texts = own.select(F.col("doc_id").cast("long").alias("doc_id"), days.cast("int").alias("day"), *(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns), self._hash(settings).alias("_hash"))
        words = self._dictionary()
        shared = self.spark.sparkContext.broadcast(words) if words else None
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        texts = texts.repartition(n, _number(width)).sortWithinPartitions("doc_id")
        to = f"{self.path}/postings/gen={gen}"
        texts.mapInArrow(_counted(list(columns.values()), width, shared), _PART).sortWithinPartitions("term", "range_no").write.option("parquet.page.row.count.limit", _PAGE).mode("overwrite").parquet(to)
        held = self.spark.read.parquet(to).filter("term = ''").select("range_no", F.col("n").cast("long").alias("n_docs"), "sum_dl", "print")
        if ranges is not None:  # ranges that have lost all their entries are told too
            held = ranges.join(held, "range_no", "left").select("range_no", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_docs", "sum_dl")), "print")
        held.coalesce(1 if gen else n).write.mode("overwrite").parquet(f"{self.path}/ranges/gen={gen}")

    def _dictionary(self) -> dict[str, int]:
        """The words that CJK text is cut into; none: it isn't cut. As bounded as the dictionary that was given."""
        if not hasattr(self, "_words"):
            self._words = {r.word: r.n for r in self.spark.read.schema("word string, n long").parquet(f"{self.path}/dictionary").collect()}
        return self._words

    def build(self, entries: DataFrame, columns: dict[str, float], width: int = 1024, day: str | None = None, dictionary: dict[str, int] | None = None) -> TextIndex:
        """Index entries (doc_id and the columns, with their weights; day: a column of dates; dictionary: words of CJK text with counts, as
        segment.free_strings() learns them)."""
        self.spark.createDataFrame(list((dictionary or {}).items()), "word string, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/dictionary")
        self._words = dict(dictionary or {})
        settings = {"columns": columns, "width": width, "day": day}
        self.spark.range(1).select(F.lit(json.dumps(settings))).coalesce(1).write.mode("overwrite").text(f"{self.path}/settings")
        self._write(entries, 0, settings, None)
        return self

    def update(self, entries: DataFrame, changed: DataFrame, gen: int | None = None) -> int:
        """Bring the index up to date: entries as they are now, changed: doc_id of those that came, changed or went. Returns the generation.

        Only ranges with a changed id are indexed again. With its number given, a generation that is written twice is the same.
        """
        settings = self._settings()
        gen = self._generations()[-1] + 1 if gen is None else gen
        number = _number(settings["width"])
        path = f"{self.path}/changed"  # a small file, so that Spark knows that it is and moves no texts to join it
        changed.filter("doc_id is not null").select(number.alias("range_no")).distinct().write.mode("overwrite").parquet(path)
        ranges = self.spark.read.schema("range_no long").parquet(path)
        self._write(entries.join(ranges, number == F.col("range_no"), "left_semi"), gen, settings, ranges)
        return gen

    def stale(self, entries: DataFrame) -> DataFrame:
        """range_no, reason (missing, gone or changed) of the ranges whose entries aren't as they were indexed."""
        now = self._prints(entries, self._settings()).withColumnRenamed("print", "now")
        both = now.join(self.current().filter("n_docs > 0").select("range_no", "print"), "range_no", "full")
        reason = F.when(F.col("print").isNull(), "missing").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("print"), "changed")
        return both.select("range_no", reason.alias("reason")).filter("reason is not null")

    def refreshed(self, entries: DataFrame) -> TextIndex:
        """The index as of these entries: a guard before a search. Ranges that are stale are indexed again, others aren't touched."""
        settings = self._settings()
        path = f"{self.path}/stale"
        self.stale(entries).write.mode("overwrite").parquet(path)
        ranges = self.spark.read.schema("range_no long, reason string").parquet(path).select("range_no")
        if not ranges.isEmpty():
            number = _number(settings["width"])
            self._write(entries.join(ranges, number == F.col("range_no"), "left_semi"), self._generations()[-1] + 1, settings, ranges)
        return self

    def compact(self) -> None:
        """Put all current blocks into one generation and drop the older ones."""
        gens = self._generations()
        if len(gens) < 2:
            return
        gen, cur = gens[-1] + 1, self.current()
        blocks = self._postings().join(cur.select("range_no", "gen"), ["range_no", "gen"], "left_semi").drop("gen")
        blocks.sortWithinPartitions("term", "range_no").write.option("parquet.page.row.count.limit", _PAGE).mode("overwrite").parquet(f"{self.path}/postings/gen={gen}")
        cur.filter("n_docs > 0").select("range_no", "n_docs", "sum_dl", "print").write.mode("overwrite").parquet(f"{self.path}/ranges/gen={gen}")
        for g in gens:
            for part in ("ranges", "postings"):
                self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/gen={g}"), True)

    # reading ----------------------------------------------------------------------------------------------------------
    def _postings(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/postings").parquet(*(f"{self.path}/postings/gen={g}" for g in self._generations()))

    def current(self) -> DataFrame:
        """range_no, gen, n_docs, sum_dl, print: of each range the newest generation."""
        r = self.spark.read.option("basePath", f"{self.path}/ranges").parquet(*(f"{self.path}/ranges/gen={g}" for g in self._generations()))
        return r.groupBy("range_no").agg(F.max_by(F.struct("gen", "n_docs", "sum_dl", "print"), "gen").alias("r")).select("range_no", "r.*")

    def _blocks(self, terms: list[str]) -> DataFrame:
        return self._postings().filter(F.col("term").isin(terms)).join(self.current().select("range_no", "gen"), ["range_no", "gen"], "left_semi")

    def _weights(self, terms: list[str]) -> tuple[dict[str, float], float]:
        """idf of the terms that occur, and the mean length; from the heads of blocks and the ranges."""
        s = self.current().agg(F.sum("n_docs").alias("n"), F.sum("sum_dl").alias("dl")).collect()[0]
        df = {r.term: r.df for r in self._blocks(terms).groupBy("term").agg(F.sum("n").alias("df")).collect()}
        return {t: math.log(1 + (s.n - x + 0.5) / (x + 0.5)) for t, x in df.items()}, (s.dl or 0) / max(s.n or 0, 1) or 1.0

    @staticmethod
    def _score(tf, dl, idf: dict[str, float], avgdl: float):
        weight = F.element_at(F.create_map(*(F.lit(x) for kv in idf.items() for x in kv)), F.col("term"))
        return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))

    def _days(self, since: str | None, until: str | None, low: str, high: str):
        number = lambda x: F.datediff(F.lit(x).cast("date"), F.lit("1970-01-01").cast("date"))
        ok = F.lit(True)
        ok = ok & (F.col(high) >= number(since)) if since else ok
        return ok & (F.col(low) <= number(until)) if until else ok

    def _bounds(self, terms, idf, avgdl, since, until, all_terms: bool) -> DataFrame:
        """range_no, gen, bound: no entry of the range has a greater score."""
        heads = self._blocks(terms).filter(self._days(since, until, "min_day", "max_day")).select("range_no", "gen", self._score(F.col("max_tf"), F.col("min_dl"), idf, avgdl).alias("s"))
        by = heads.groupBy("range_no", "gen").agg(F.sum("s").alias("bound"), F.count(F.lit(1)).alias("held"))
        return by.filter(F.col("held") == len(terms)) if all_terms else by

    def _scored(self, ranges: DataFrame, terms, idf, avgdl, since, until, all_terms: bool, without=()) -> DataFrame:
        """doc_id, n_terms, score of the entries of these ranges."""
        rows = self._postings().filter(F.col("term").isin(terms)).join(ranges.select("range_no", "gen"), ["range_no", "gen"], "left_semi").select("term", F.inline(F.arrays_zip("docs", "days", "tfs", "dls")))
        rows = rows.filter(self._days(since, until, "days", "days")).select(F.col("docs").alias("doc_id"), self._score(F.col("tfs"), F.col("dls"), idf, avgdl).alias("s"))
        out = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("s"), 4).alias("score"))
        if without:
            gone = self._postings().filter(F.col("term").isin(list(without))).join(ranges.select("range_no", "gen"), ["range_no", "gen"], "left_semi")
            out = out.join(gone.select(F.explode("docs").alias("doc_id")), "doc_id", "left_anti")
        return out.filter(F.col("n_terms") == len(terms)) if all_terms else out

    def _chosen(self, terms: list[str], k: int, since, until, all_terms: bool, without=()):
        """(ranges that may hold one of the k best, idf, mean length); None where no entry can match.

        The ranges of greatest bound, some that hold four times k ids, are scored first; the k-th score among them is one that
        every other range must be able to reach.
        """
        idf, avgdl = self._weights(terms)
        if not idf or (all_terms and len(idf) < len(terms)):
            return None
        bounds = self._bounds(terms, idf, avgdl, since, until, all_terms)
        first = bounds.orderBy(F.desc("bound"), "range_no").limit(max(4, -(-4 * k // self._settings()["width"])))
        top = self._scored(first, terms, idf, avgdl, since, until, all_terms, without).orderBy(F.desc("score"), "doc_id").limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect()[0]
        if top.n >= k:  # scores are rounded, so bounds get half a place more
            bounds = bounds.filter(F.col("bound") + 1e-4 >= top.least)
        return bounds, idf, avgdl

    def search(self, terms: list[str], k: int = 100, since: str | None = None, until: str | None = None, all_terms: bool = False, without: list[str] = ()) -> DataFrame:
        """doc_id, n_terms, score of the k best entries by (score, smaller id) with any term, or with all, and with none of `without`. Exact:
        blocks that can't matter aren't read."""
        terms = list(dict.fromkeys(t.lower() for t in terms))[:MOST_TERMS]
        without = [t.lower() for t in without]
        found = self._chosen(terms, k, since, until, all_terms, without) if terms else None
        if found is None:
            return self.spark.createDataFrame([], "doc_id long, n_terms long, score double")
        ranges, idf, avgdl = found
        return self._scored(ranges, terms, idf, avgdl, since, until, all_terms, without).orderBy(F.desc("score"), "doc_id").limit(k)

    def and_then_or(self, terms: list[str], k: int = 100, least: int = 3, since: str | None = None, until: str | None = None) -> DataFrame:
        """search() for all terms if at least `least` entries have them all, else for any."""
        both = self.search(terms, max(k, least), since, until, True)
        return both.orderBy(F.desc("score"), "doc_id").limit(k) if both.limit(least).count() >= least else self.search(terms, k, since, until)

    def ask(self, text: str, k: int = 100, stop_words: frozenset = frozenset(), since: str | None = None, until: str | None = None) -> DataFrame:
        """search() for a question: CJK is cut into words, any of which will do; of other words all, else any, without stop words unless there are no others."""
        terms = query_terms(text, Lattice(self._dictionary()) if self._dictionary() else None)
        terms = [t for t in terms if t not in stop_words] or terms
        return self.search(terms, k, since, until) if _CJK.search(text) else self.and_then_or(terms, k, since=since, until=until)

    def reads(self, terms: list[str], k: int = 100) -> dict[str, int]:
        """How many blocks and postings the terms have, and how many of them search() reads."""
        held = self._blocks(terms)
        found = self._chosen(terms, k, None, None, False)
        read = held.join(found[0].select("range_no", "gen"), ["range_no", "gen"], "left_semi") if found else held.limit(0)
        count = lambda df: df.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).collect()[0].asDict()
        return {f"{name}_{what}": v for name, df in (("all", held), ("read", read)) for what, v in count(df).items()}
