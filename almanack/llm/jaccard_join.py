"""Near-duplicate classes by a grouped prefix join on word shingles.

A document's set holds its distinct 5-word shingles. In any order of shingles that all documents share, two sets with a
Jaccard similarity of t or more have a shingle in common among the first n - ceil(t n) + 1 of each (the prefix). The order
used here is that of a hash, with *hot* shingles last: those that more than `hot` sets have in their prefix, counted over
all documents, with a second count for those that took the place of hot ones. The order affects the work only, never the
result.

Documents with equal prefix and size make one *group*; groups, not documents, are joined on their prefix shingles:

* cold shingles: all pairs of groups in a bucket (at most about `hot` groups), with the size filter; a pair then needs
  as many common prefix shingles as the rest of the sets can't make up for.
* hot shingles (they remain in the prefix of documents that have hardly any other): each group is paired with two
  representatives of the bucket. No bucket is gathered in a task, and no pairs within it are made.

Pairs of groups are expanded to members (documents with equal sets count once) and verified on the whole texts. First a
spanning choice of pairs is verified and linked documents are merged into classes. Then all remaining pairs between
different classes, those of hot buckets included, are verified, which makes the result exact: a pair that is left out
lies within one class already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, fresh_path, pieces, small_batches, table, written
from .components import components

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(32)
_EMPTY = np.empty(0, np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


class Words:
    """64-bit hashes of a text's words: sums of a random number per byte times a power of an odd base, by running sums."""

    def __init__(self):
        rng = np.random.default_rng(20240229)
        self.of_byte = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(1 << 60, 1 << 63)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(2 * n, 1 << 14)
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n, self.base, np.uint64)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n, self.inverse, np.uint64)))

    def hashes(self, raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw.lower(), np.uint8)
        if not len(b):
            return _EMPTY
        self._powers(len(b))
        inside = np.zeros(len(b) + 2, bool)
        np.logical_not(self.space[b], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.of_byte[b] * self.up[: len(b)], out=run[1:])
        return _finish((run[end] - run[start]) * self.down[start])


def shingle_set(raw: bytes, words: Words, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; of the whole word sequence if that is shorter."""
    w = words.hashes(raw)
    n = len(w)
    if not n:
        return _EMPTY
    k = min(n, width)
    s = w[: n - k + 1] * _C[0]
    for i in range(1, k):
        s += w[i : n - k + 1 + i] * _C[i % 5]
    s = np.sort(_finish(s + np.uint64(k)))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _need(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _member(x: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(x), bool)
    return hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x


def prefix(s: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(cold, hot) shingles of a set's prefix: cold ones by hash, then hot ones by hash."""
    p = len(s) - _need(len(s), percent) + 1
    if not len(hot):
        return s[:p], _EMPTY
    # only as much of the set as the prefix can reach
    end, cold = p, s[:p]
    while True:
        is_hot = _member(s[:end], hot)
        cold = s[:end][~is_hot]
        if len(cold) >= p or end == len(s):
            break
        end = min(len(s), end + (p - len(cold)) + 16)
    if len(cold) >= p:
        return cold[:p], _EMPTY
    return cold, s[is_hot][: p - len(cold)]


def _texts(batch: pa.RecordBatch):
    for part in pieces([batch]):
        yield from zip(part.column(0).to_pylist(), (x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()), strict=True)


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(np.asarray(v, np.uint64).view(np.int64) if not isinstance(v, pa.Array) else v) for k, v in columns.items()})


def _counted(x: list[np.ndarray]) -> pa.RecordBatch:
    name, n = np.unique(np.concatenate(x) if x else _EMPTY, return_counts=True)
    return _table(name=name, n=n.astype(np.uint64))


def count_prefixes(hot, width: int, percent: int):
    """Of each batch: prefix shingles and how many different sets have them; with hot: only what took the place of hot ones."""

    def run(batches):
        words = Words()
        for batch in batches:
            seen, out = set(), []
            for _, raw in _texts(batch):
                s = shingle_set(raw, words, width)
                if not len(s) or (mark := hash(s.tobytes())) in seen:
                    continue
                seen.add(mark)
                first = s[: len(s) - _need(len(s), percent) + 1]
                if hot is None:
                    out.append(first.copy())  # a view would keep the whole set
                elif k := int(_member(first, hot.value).sum()):
                    # what the prefix will reach if the rest is as hot, and half as much again
                    p = len(first)
                    out.append((s[p : p + (3 * k * p) // (2 * (p - k)) + 16] if k < p else s[p:]).copy())
            yield _counted(out)

    return run


def _group(n: int, cold: np.ndarray, hot: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(cold.tobytes() + hot.tobytes(), n)


def describe(hot, width: int, percent: int):
    """Of each document: size and name of its set, its group, hot shingles in its prefix."""

    def run(batches):
        words = Words()
        for batch in batches:
            sizes, names, groups, hots = [], [], [], []
            for _, raw in _texts(batch):
                s = shingle_set(raw, words, width)
                cold, h = prefix(s, hot.value, percent) if len(s) else (s, s)
                sizes.append(len(s))
                names.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                groups.append(_group(len(s), cold, h) if len(s) else 0)
                hots.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array(v, np.uint64).view(np.int64)) for v in (sizes, names, groups, hots))], names=["doc_id", "n", "name", "grp", "n_hot"])

    return run


def prefixes(hot, width: int, percent: int, most_seen: int = 1 << 18):
    """The prefix shingles of each group, once for each `most_seen` groups of a task."""

    def run(batches):
        words, seen = Words(), set()
        for batch in batches:
            rows = []
            if len(seen) > most_seen:
                seen.clear()
            for _, raw in _texts(batch):
                s = shingle_set(raw, words, width)
                if len(s):
                    cold, h = prefix(s, hot.value, percent)
                    if (g := _group(len(s), cold, h)) not in seen:
                        seen.add(g)
                        rows.append((g, len(s), cold.copy(), h))
            count = [len(c) + len(h) for _, _, c, h in rows]
            each = lambda k, v: np.repeat(np.array(v, np.uint64), count)
            yield _table(
                shingle=np.concatenate([x for r in rows for x in r[2:]]) if rows else _EMPTY,
                grp=each(0, [r[0] for r in rows]), n=each(1, [r[1] for r in rows]), n_hot=each(2, [len(r[3]) for r in rows]),
                is_hot=np.concatenate([np.repeat(np.array([0, 1], np.uint64), [len(r[2]), len(r[3])]) for r in rows]) if rows else _EMPTY,
            )

    return run


def verify(width: int, percent: int):
    """(a, b) of the rows (a, b, text_a, text_b) whose texts are similar enough."""

    def run(batches):
        words, known = Words(), {}
        for batch in pieces(batches, 64):
            cols = [batch.column(i).to_pylist() for i in range(2)] + [batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)]
            a_out, b_out = [], []
            for a, b, ta, tb in zip(*cols, strict=True):
                if a not in known:
                    if len(known) > 64:
                        known.clear()
                    known[a] = shingle_set(ta or b"", words, width)
                x, y = known[a], shingle_set(tb or b"", words, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _similar_size(percent: int, x: str = "n1", y: str = "n2"):
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def _links(pairs: DataFrame, docs: DataFrame, width: int, percent: int, most_ids: int, spread: int = 256) -> DataFrame:
    """Verified links among pairs (a, b); a is the side that may be in very many pairs: its text goes to each `spread` of them."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    wanted = docs.filter("doc_id is not null")
    wanted = wanted.join(F.broadcast(ids) if ids.count() <= most_ids else ids, "doc_id", "left_semi")
    of_a = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / spread).alias("salts"))
    texts_a = of_a.join(wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("a", "salt", "text_a")
    rows = pairs.join(of_a, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    rows = rows.join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts_a, ["a", "salt"])
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(frees(verify(width, percent)), "a long, b long")


def _spread(big: DataFrame, small: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """big with the row of small of its key (inner join): small's rows are copied to salts, over which big's are dealt, as one key may hold most of big."""
    dealt = big.withColumn("salt", F.pmod(F.xxhash64(by, F.lit(5)), F.lit(salts)))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [key, "salt"]).drop("salt")


def _stars(pairs: DataFrame, sets: DataFrame, percent: int, most: int = 2) -> DataFrame:
    """Of the pairs (a: a bucket's representative, b, n2) each b's `most` that share most buckets with it."""
    common = pairs.filter("a != b").groupBy("a", "b", "n2").agg(F.count(F.lit(1)).alias("common"))
    common = common.join(sets.select(F.col("doc").alias("a"), F.col("n").alias("n1")), "a").filter(_similar_size(percent))
    best = common.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("common"), "a"))), 1, most).alias("x"))
    return best.select(F.explode("x.a").alias("a"), "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, hot: int = 24, most_hot: int = 1 << 20, most_ids: int = 1 << 20, carried: int = 64, block: int = 256) -> DataFrame:
    """Near-duplicate classes of documents: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than `width` has its whole
    sequence as one shingle; one without words, or null, has none and no link. Ids should be unique; rows with equal ids
    are kept, each with its own set, and a row with a null id gets the class of its equals (null if it has none). Shingles are
    compared by 64-bit hashes. `most_hot` bounds what is broadcast of hot shingles: where more are found, the count from
    which one is hot is raised. `most_ids` bounds the ids broadcast to pick texts; beyond it they are joined. `carried` is how many hot shingles go with a
    document to make each pair once (`block`: rows of a bucket paired by one task's key); with more, a pair may be made in several buckets, and counts once all the same.
    """
    spark = small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def hottest(known) -> np.ndarray:
        counted = docs.mapInArrow(frees(count_prefixes(known, width, percent)), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") > hot)
        path = fresh_path(spark, "hot")
        counted.write.parquet(path)
        counted, least = spark.read.schema("name long, n long").parquet(path), hot
        while counted.count() > most_hot:
            least *= 2
            counted = counted.filter(F.col("n") > least)
        return np.sort(np.array([r.name for r in counted.select("name").collect()], np.int64).view(np.uint64))

    found = hottest(None)
    if len(found):
        more = hottest(spark.sparkContext.broadcast(found))
        found = np.union1d(found, more) if len(found) + len(more) <= 2 * most_hot else found
    known = spark.sparkContext.broadcast(found)

    nodes = written(docs.mapInArrow(frees(describe(known, width, percent)), "doc_id long, n long, name long, grp long, n_hot long"), "nodes")
    sets = nodes.filter("n > 0 and doc_id is not null").groupBy("n", "name", "grp", "n_hot").agg(F.min("doc_id").alias("doc"))
    sets = written(sets, "sets")
    rows = docs.mapInArrow(frees(prefixes(known, width, percent)), "shingle long, grp long, n long, n_hot long, is_hot long")

    # groups that share cold shingles
    cold = rows.filter("is_hot = 0").select("shingle", "grp", "n", "n_hot").repartition("shingle").distinct()
    x, y = (cold.select("shingle", *(F.col(c).alias(f"{c}{i}") for c in ("grp", "n", "n_hot"))) for i in (1, 2))
    rest = f"greatest(ceil(n1 * {percent} / 100), ceil(n2 * {percent} / 100)) - 1 + least(n_hot1, n_hot2)"
    pairs = x.join(y, "shingle").filter("grp1 < grp2").filter(_similar_size(percent)).groupBy("grp1", "grp2", "n1", "n2", "n_hot1", "n_hot2").agg(F.count(F.lit(1)).alias("common"))
    pairs = pairs.filter(F.expr(f"{100 + percent} * (common + {rest}) >= {percent} * (n1 + n2)"))
    member = sets.select("grp", "doc")
    pairs = written(pairs.select("grp1", "grp2"), "group-pairs")
    # each member of a group with the first one of the other: as many rows as members, not their products
    first = sets.groupBy("grp").agg(F.min("doc").alias("a"))
    ways = [pairs.select(F.col(x).alias("grp"), F.col(y).alias("other")) for x, y in (("grp1", "grp2"), ("grp2", "grp1"))]
    close = ways[0].union(ways[1]).join(first, "grp").select("a", F.col("other").alias("grp")).join(member, "grp").select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b"))

    # buckets that may be large: a hot shingle's groups, and a group's own members
    hots = written(rows.filter("is_hot = 1").groupBy("grp").agg(F.sort_array(F.collect_set("shingle")).alias("hots")).join(member, "grp").select("doc", "hots"), "hots")
    hot_rows = hots.select(F.explode("hots").alias("bucket"), "doc", F.lit(False).alias("own"))
    several = sets.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    own_rows = sets.join(several, "grp").select(F.col("grp").alias("bucket"), "doc", F.lit(True).alias("own"))
    # most: prefix shingles that two members of the bucket can have in common
    buckets = written(hot_rows.union(own_rows).join(sets.select("doc", "n", "n_hot", "grp"), "doc").select("bucket", "own", "doc", "grp", "n", F.expr("if(own, n, n_hot)").alias("most")), "buckets")
    heads = buckets.groupBy("bucket").agg(F.min("doc").alias("h1"), F.min_by("doc", F.xxhash64("doc")).alias("h2"))
    stars = _stars(_spread(buckets, heads, "bucket", "doc").select(F.explode(F.array_distinct(F.array("h1", "h2"))).alias("a"), F.col("doc").alias("b"), F.col("n").alias("n2")), sets, percent)

    spanning = close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = written(_links(spanning.union(stars).distinct(), docs, width, percent, most_ids), "links")
    merged = written(components(links), "merged")

    def label(d: DataFrame, k: str) -> DataFrame:
        return d.join(merged.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")), k, "left").withColumn(f"c_{k}", F.coalesce(f"c_{k}", k))

    def joined(more: DataFrame) -> DataFrame:
        heads = merged.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a != b")
        return written(components(heads.union(more)), "merged")

    def mixed_rows() -> DataFrame:
        """Rows of the buckets that hold several classes."""
        placed = label(buckets, "doc")
        mixed = placed.groupBy("bucket").agg((F.min("c_doc") != F.max("c_doc")).alias("mixed")).filter("mixed").select("bucket")
        return written(_spread(placed, mixed, "bucket", "doc"), "mixed")

    placed = mixed_rows()
    if placed.limit(1).count():
        # those outside a bucket's largest class try two other members of it before all pairs are made
        sizes = placed.groupBy("bucket", "c_doc").agg(F.count(F.lit(1)).alias("k"), F.min_by("doc", F.xxhash64("doc", F.lit(1))).alias("h1"), F.min_by("doc", F.xxhash64("doc", F.lit(2))).alias("h2"))
        largest = sizes.groupBy("bucket").agg(F.max_by(F.struct("c_doc", "h1", "h2"), F.struct("k", -F.col("c_doc"))).alias("top"))
        tries = _spread(placed, largest, "bucket", "doc").filter("c_doc != top.c_doc").select(F.explode(F.array_distinct(F.array("top.h1", "top.h2"))).alias("a"), F.col("doc").alias("b"), F.col("n").alias("n2"))
        merged = joined(_links(_stars(tries, sets, percent), docs, width, percent, most_ids))
        placed = mixed_rows()
    # of two groups, members are paired only where they aren't all in one class already
    placed_members = label(member, "doc")
    span = placed_members.groupBy("grp").agg(F.min("c_doc").alias("low"), F.max("c_doc").alias("high"))
    apart = pairs.join(span.toDF("grp1", "low1", "high1"), "grp1").join(span.toDF("grp2", "low2", "high2"), "grp2").filter("least(low1, low2) < greatest(high1, high2)").select("grp1", "grp2")
    left = apart.join(placed_members.select(F.col("grp").alias("grp1"), F.col("doc").alias("d1"), F.col("c_doc").alias("c1")), "grp1").join(placed_members.select(F.col("grp").alias("grp2"), F.col("doc").alias("d2"), F.col("c_doc").alias("c2")), "grp2").filter("c1 != c2")
    left = left.select(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).distinct().join(spanning, ["a", "b"], "left_anti")
    # pairs with a cold shingle in common are among the close ones if they can be links; the others need enough hot ones
    # each pair is made in one bucket: that of its group, or else of the first hot shingle that both have in common
    placed = placed.join(hots.select("doc", F.slice("hots", 1, carried).alias("first")), "doc", "left")
    # a bucket is cut into blocks of about `block` rows, and each pair of blocks is a key of its own, so that no task gets a whole bucket
    large = placed.groupBy("bucket", "own").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).filter("blocks > 1")
    placed = placed.join(F.broadcast(large) if large.count() <= most_ids else large, ["bucket", "own"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(3)), "blocks"))
    side = lambda i, low, high: placed.select("bucket", "own", *(F.col(c).alias(f"{c}{i}") for c in ("doc", "grp", "n", "c_doc", "most", "first")), low.alias("low"), high.alias("high"))
    x = side(1, F.col("block"), F.explode(F.sequence("block", F.col("blocks") - 1)))
    y = side(2, F.explode(F.sequence(F.lit(0).cast("long"), "block")), F.col("block"))
    rest = f"greatest(ceil(n1 * {percent} / 100), ceil(n2 * {percent} / 100)) - 1"
    can = lambda common: F.expr(f"{100 + percent} * ({common} + {rest}) >= {percent} * (n1 + n2)")
    both = "array_intersect(first1, first2)"
    pair = x.join(y, ["bucket", "own", "low", "high"]).filter("(low < high or doc1 < doc2) and c_doc1 != c_doc2").filter(_similar_size(percent)).filter(can("least(most1, most2)"))
    once = F.expr(f"own or (grp1 != grp2 and coalesce(get({both}, 0) >= bucket, true))")
    across = pair.filter(once).filter(F.expr(f"own or greatest(most1, most2) > {carried}") | can(f"size({both})")).select(F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b"))
    left = written(left.union(across).distinct(), "left")
    if left.limit(1).count():
        merged = joined(_links(left, docs, width, percent, most_ids))
    by_set = sets.select("n", "name", "doc").join(merged.select(F.col("node").alias("doc"), "component"), "doc", "left").select("n", "name", F.coalesce("component", "doc").alias("component"))
    linked = nodes.filter("n > 0").join(by_set, ["n", "name"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return linked.union(nodes.filter("n = 0").select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", most_broadcast: int = 1 << 20, **options) -> DataFrame:
    """The rows of docs without those that are near duplicates of one with a smaller id, with all their columns.

    Rows with a null id stay. Where ids repeat, each row is judged by its own text: of rows that share an id, those go that
    are near duplicates of another.
    """
    if docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").limit(1).count():
        rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        named = rows.filter(F.col(id_col).isNotNull())
        found = written(classes(named, "__row", **options).withColumnRenamed("doc_id", "__gone").join(named.select(F.col("__row").alias("__gone"), F.col(id_col).alias("id")), "__gone"), "classes")
        first = found.groupBy("component_id").agg(F.min(F.struct("id", "__gone")).alias("first"))
        gone = written(found.join(first.select(F.col("first.__gone").alias("__gone")), "__gone", "left_anti").select("__gone"), "gone")
        docs, by = rows, "__row"
    else:
        found = written(classes(docs, id_col, **options).filter("doc_id is not null"), "classes")
        gone, by = written(found.filter("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone"), id_col
    small = gone.count() <= most_broadcast
    return docs.join(F.broadcast(gone) if small else gone, docs[by] == gone["__gone"], "left_anti").drop("__row")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return classes(table(spark, sf_dir, "documents"))
