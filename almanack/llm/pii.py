"""Personal data by patterns and by bootstrapped context, in DataFrame functions only.

Plain patterns find e-mail addresses, IP addresses, card and phone numbers. These are the seeds. The two words to the left
of a value and the two to its right are lexical patterns (digits in them count alike, an earlier or later value of the
same kind is the word `#`). Any other long number, or word of letters and digits, is a candidate with patterns of its own.
Patterns and values make a graph that is scored in rounds:

* A pattern with enough different trusted values (seeds at first) stands. One without any and enough candidates contradicts.
* A value's score is the share of the standing among its standing and contradicting patterns; a pattern's score is the mean
  over its trusted values (1 each) and those of its candidates that a contradicting pattern has too. Candidates that
  nothing contradicts, however many, count neither way. Patterns below the least score fall and contradict in turn, until
  none falls.
* Candidates of the patterns that remain, unless more patterns contradict than stand, are trusted from then on: they induce
  patterns of their own in the next round, which stand only if at least half of their values are trusted (a pattern of
  thousands of order numbers isn't taught by twenty of them). The rounds end when nothing new is trusted.

Candidates with a pattern that stands at the end are reported as kind `context`.

Regular expressions are Java's, with possessive quantifiers where nothing that follows could use what was taken, so that
very long runs neither recurse nor backtrack; a match starts where a run of its first characters starts, or where the
last match ended. Texts are read once, in one stage without shuffle; spans and candidates go to the shared folder, and the
rounds see candidates only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, table, written

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates: seven digits or more between word edges, with the separators that numbers have.
NUMBER = r"(?<![\p{L}\p{N}_@.%+=/-])[0-9][0-9./-]{5,}+(?![\p{L}_@%+=])"
#: Candidates with letters too: four digits and one letter or more between word edges.
MIXED = r"(?<![\p{L}\p{N}_@.%+=/-])(?=(?:[A-Za-z/-]*+[0-9]){4})(?=[0-9/-]*+[A-Za-z])[A-Za-z0-9]++(?:[/-][A-Za-z0-9]++)*+(?![\p{L}\p{N}_@%+=])"
KINDS = ("email", "ip", "card", "phone")
#: Groups of digits with single blanks between them.
GROUPED = r"(?<![\p{L}\p{N}_@.%+=/-])(?<![0-9]\x20)[0-9]{2,6}+(?:\x20[0-9]{2,6}+)++(?![\p{L}\p{N}_@%+=-])"
_SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
#: 1, 2, 4, ...: steps of a running sum by doubling.
_STEPS = f"array({', '.join(str(1 << k) for k in range(30))})"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _words(text: str, pattern: str, side: str) -> str:
    """SQL: the words that pattern takes from text, lower-cased, digits alike; null if there aren't two."""
    return f"nullif(concat('{side} ', regexp_replace(regexp_replace(regexp_extract(lower({text}), {_sql(pattern)}, 1), '[0-9]+', '0'), {_sql(chr(92) + 's+')}, ' ')), '{side} ')"


def _spans(pattern: str, text: str = "text") -> str:
    """SQL: (start, end, value, left, right) of every match, in code points; left and right are its patterns.

    Ends are running sums of the lengths of gaps and matches, doubled up, so that a text with many matches costs n log n.
    """
    p = _sql(f"({pattern})")
    ends = f"aggregate({_STEPS}, transform(m, (v, i) -> length(g[i]) + length(v)), (x, k) -> if(size(x) <= k, x, transform(x, (v, i) -> v + if(i < k, 0, x[if(i < k, 0, i - k)]))))"
    left = _words("concat(if(i > 0, '# ', ''), g[i])", r"(?<!\S)(\S++\s++\S++)\s*+\z", "L")
    right = _words("concat(g[i + 1], if(i + 1 < size(m), ' #', ''))", r"\A\s*+(\S++\s++\S++)", "R")
    each = f"element_at(transform(array({ends}), e -> transform(m, (v, i) -> named_struct('start', e[i] - length(v), 'end', e[i], 'value', v, 'left', {left}, 'right', {right}))), 1)"
    inner = f"element_at(transform(array(split({text}, {p}, -1)), g -> {each}), 1)"
    return f"element_at(transform(array(regexp_extract_all({text}, {p}, 1)), m -> if(size(m) = 0, cast(array() as {_SPAN}), {inner})), 1)"


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = """aggregate(transform(sequence(1, greatest(length(d), 1)), i -> element_at(transform(array(cast(substring(reverse(d), i, 1) as int)), v ->
    if(i % 2 = 1, v, if(v > 4, 2 * v - 9, 2 * v))), 1)), 0, (a, v) -> a + v) % 10 = 0"""
#: For each kind: what a text must have for a match, the pattern, and what a match must meet.
BASE = {
    "email": ("contains(text, '@')", EMAIL, "true"),
    "ip": (f"text rlike {_sql('[0-9][.][0-9]+[.][0-9]')}", IP, "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(right(p, 3) as int) <= 255)"),
    "card": (f"text rlike {_sql('(?:[0-9][ -]?+){16}')}", CARD, f"element_at(transform(array({_DIGITS}), d -> length(d) between 16 and 19 and {_LUHN}), 1)"),
    "phone": ("contains(text, '+')", PHONE, f"length({_DIGITS}) between 8 and 15"),
}


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, one array of spans per kind, and candidates. One pass over the texts."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = f"cast(array() as {_SPAN})"
    cols = {k: F.expr(f"if({has}, filter({_spans(p)}, x -> {keep}), {none})") for k, (has, p, keep) in BASE.items()}
    number = f"if(text rlike {_sql('[0-9][0-9./-]{5}')}, filter({_spans(NUMBER)}, x -> length({_DIGITS}) >= 7), {none})"
    mixed = f"if(text rlike {_sql(MIXED)}, filter({_spans(MIXED)}, x -> length(regexp_replace(x.value, '[^0-9A-Za-z]', '')) >= 7), {none})"
    grouped = f"if(text rlike {_sql('[0-9]{2} [0-9]{2}')}, filter({_spans(GROUPED)}, x -> length({_DIGITS}) >= 7), {none})"
    cols["number"] = F.expr(f"concat({number}, {mixed}, {grouped})")
    return d.select("doc_id", *(c.alias(k) for k, c in cols.items()))


def _tagged(big: DataFrame, small: DataFrame, key: str, other: str, most_broadcast: int, salts: int = 16) -> DataFrame:
    """big with small's columns (left join on key): by broadcast while small has most_broadcast rows at most, else big's rows are dealt over salts by `other`."""
    if small.count() <= most_broadcast:
        return big.join(F.broadcast(small), key, "left")
    dealt = big.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(salts)))
    return dealt.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [key, "salt"], "left").drop("salt")


def bootstrap(edges: DataFrame, min_seeds: int = 5, min_score: float = 0.8, min_share: float = 0.5, most_broadcast: int = 100_000) -> DataFrame:
    """edges: (pattern, value, trusted), distinct. The patterns that stand when nothing new is trusted any more.

    A pattern with min_seeds values or more that are trusted from the start may stand, and one with as many learnt ones if
    they are min_share of its values or more. One without trusted values and min_seeds values or more contradicts.
    Counts are summed in parts before each shuffle, so a pattern or value with a third of all edges is no one task's work;
    patterns or values join edges by broadcast only up to most_broadcast of them.
    """
    tag = lambda big, small, key: _tagged(big, small, key, "value" if key == "pattern" else "pattern", most_broadcast)
    sized = written(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_seeds).select("pattern", F.lit(True).alias("sized")), "patterns")
    # other patterns can neither stand nor contradict
    edges = written(tag(edges, sized, "pattern").filter("sized").select("pattern", "value", "trusted", F.col("trusted").alias("seed")), "edges")
    accepted = edges.select("pattern").limit(0)
    while True:
        support = edges.groupBy("pattern").agg(F.count_if("trusted").alias("pos"), F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("n"))
        stands = (F.col("seeds") >= min_seeds) | ((F.col("pos") >= min_seeds) & (F.col("pos") >= min_share * F.col("n")))
        state = written(support.withColumn("stands", stands).filter("stands or pos = 0").select("pattern", "pos", "stands"), "state")
        if not state.filter("stands").limit(1).count():
            return accepted
        while True:
            placed = tag(edges, state.select("pattern", "stands"), "pattern").filter("stands is not null")
            votes = written(placed.filter("not trusted").groupBy("value").agg(F.count_if("stands").alias("pro"), F.count_if(~F.col("stands")).alias("contra")).filter("pro > 0 and contra > 0"), "votes")
            wrong = tag(placed.filter("stands and not trusted"), votes, "value").filter("contra > 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pro") / (F.col("pro") + F.col("contra"))).alias("s"))
            fallen = written(wrong.join(state.select("pattern", "pos"), "pattern").filter(F.col("pos") + F.col("s") < min_score * (F.col("pos") + F.col("n"))).select("pattern", F.lit(True).alias("fell")), "fallen")
            if not fallen.limit(1).count():
                break
            state = written(tag(state.withColumn("value", F.col("pos")), fallen, "pattern").select("pattern", "pos", (F.col("stands") & F.col("fell").isNull()).alias("stands")), "state")
        accepted = written(state.filter("stands").select("pattern"), "accepted")
        reached = tag(edges.filter("not trusted"), accepted.withColumn("stands", F.lit(True)), "pattern").filter("stands").select("value").distinct()
        new = written(reached.join(votes.filter("contra > pro"), "value", "left_anti").withColumn("new", F.lit(True)), "trusted")
        if not new.limit(1).count():
            return accepted
        edges = written(tag(edges, new, "value").select("pattern", "value", (F.col("trusted") | F.col("new").isNotNull()).alias("trusted"), "seed"), "edges")


def discover(spans: DataFrame, most_broadcast: int = 100_000, **options) -> DataFrame:
    """spans: rows of found() with a row number `row`. Candidates that their patterns confirm: (row, start, end)."""
    both = F.explode(F.filter(F.array("x.left", "x.right"), lambda p: p.isNotNull()))
    seeds = reduce(DataFrame.unionByName, (spans.select(F.explode(k).alias("x")).select(both.alias("pattern"), F.concat(F.lit(f"{k}:"), "x.value").alias("value"), F.lit(True).alias("trusted")) for k in KINDS))
    taken = F.flatten(F.array(*KINDS))
    free = F.filter("number", lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    cand = spans.filter(F.size("number") > 0).select("row", F.explode(free).alias("x")).select("row", "x.start", "x.end", F.col("x.value").alias("value"), both.alias("pattern"))
    edges = seeds.unionByName(cand.select("pattern", F.concat(F.lit("number:"), "value").alias("value"), F.lit(False).alias("trusted"))).distinct()
    accepted = bootstrap(edges, most_broadcast=most_broadcast, **options)
    return _tagged(cand, accepted.withColumn("stands", F.lit(True)), "pattern", "row", most_broadcast).filter("stands").select("row", "start", "end")


def _labelled(kind: str, column: str) -> F.Column:
    return F.transform(column, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, base kinds as listed, then context).

    A null text counts as empty. Ids are carried only: nulls and repeats are fine, each row is judged for itself; repeated
    texts count once as evidence for a pattern, as values are distinct. Other columns are ignored. options: those of
    bootstrap().
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "spans")
    found(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    spans = spark.read.parquet(path)
    more = discover(spans, **options).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("context"))
    kinds = F.concat(*(_labelled(k, k) for k in KINDS))
    out = spans.select("row", "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), _joined(kinds).alias("base")).join(more, "row", "left")
    extra = _joined(_labelled("context", "context"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), extra).alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Every document scanned for personal data."""
    return scan(table(spark, sf_dir, "documents"))
