"""Quality rules as a short-circuit cascade, ordered by rejection per cost as estimated on a sample.

Each rule is a condition to keep a document; some need the base figures only, others go through the text or its words
again. One job over a sample (about `sample_rows` rows) evaluates every rule on every row `repeats` times between two
readings of the clock, inside the tasks, so that scheduling and compilation don't count, and adds up, for each
combination of verdicts, the rows and the least times. From these few sums the order is chosen greedily: next comes the
rule that rejects most per nanosecond *of the rows that the rules before it keep*. A document that one rule rejects is
not looked at by the next (CASE is evaluated lazily). The order changes the work, never the verdict: a document is kept if
no rule rejects it. DataFrame functions only.

Windows and lines are compared by value or by 64-bit hashes of a single text's windows (n of them: n * n / 2**65 expected errors).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: White space for a character class within an SQL text.
SPACE = r" \\t\\n\\x0B\\f\\r"


def let(value, body, name: str = "v"):
    """SQL of body with name bound to value, evaluated once (not once for each use within a lambda)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def n_repeat_words_sql(words: str) -> str:
    """Words that lie in a 3-word window found twice or more in the text, the first included.

    Windows are compared by 64-bit hashes: sorted, so equal ones are neighbours, with their places.
    """
    windows = "array_sort(transform(sequence(0, size(w) - 3), i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i)))"
    places = "transform(filter(s, (x, j) -> x.h = get(s, j - 1).h or x.h = get(s, j + 1).h), x -> array(x.i, x.i + 1, x.i + 2))"
    return let(words, f"if(size(w) < 4, 0, {let(windows, f'size(array_distinct(flatten({places})))', 's')})", "w")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words and the base figures of each text. A null text has no words and zeros. Other columns are left out."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.expr(f"filter(split(text, '[{SPACE}]+'), x -> x != '')"))
    lines = let(f"filter(split(text, '\\n'), x -> x rlike '[^{SPACE}]')", "size(l) - size(array_distinct(l))", "l")
    return d.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.expr(lines).cast("long").alias("n_dup_lines"),
        F.expr(n_repeat_words_sql("words")).cast("long").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """keep: SQL condition over the columns of measures()."""

    name: str
    keep: str


#: Thresholds are the usual ones of published web-text filters: word length, symbols to words, repeated lines, letters, capitals, variety.
RULES = (
    Rule("mean_word_length", "word_chars between 2 * n_words and 15 * n_words"),
    Rule("symbols", "5 * n_symbols <= n_words"),
    Rule("dup_lines", "2 * n_dup_lines <= size(split(text, '\\n'))"),
    Rule("capitals", "2 * length(regexp_replace(text, '[^A-Z]', '')) <= word_chars"),
    Rule("letters", "2 * length(regexp_replace(text, '[^\\\\p{L}]', '')) >= word_chars"),
    Rule("distinct_words", "size(array_distinct(words)) >= 15"),
)


def _timed(condition: str, repeats: int) -> str:
    """SQL: (least nanoseconds, verdict) of a condition, evaluated `repeats` times between two readings of the clock."""
    clock = "cast(reflect('java.lang.System', 'nanoTime') as bigint)"
    once = let(f"named_struct('a', {clock}, 'keep', {condition}, 'b', {clock})", "named_struct('ns', t.b - t.a, 'keep', t.keep)", "t")
    return f"array_min(transform(sequence(1, {repeats}), i -> {once}))"


def observed(measured: DataFrame, rules=RULES, repeats: int = 3) -> list[tuple[tuple[bool, ...], int, tuple[float, ...]]]:
    """(verdicts by rule, rows, nanoseconds by rule) of each combination of verdicts, by one job."""
    timed = measured.select(*(F.expr(_timed(r.keep, repeats)).alias(f"t{k}") for k, r in enumerate(rules)))
    keep = F.array(*(F.coalesce(F.col(f"t{k}.keep"), F.lit(False)) for k in range(len(rules))))
    sums = timed.groupBy(keep.alias("keep")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"t{k}.ns").alias(f"t{k}") for k in range(len(rules))))
    return [(tuple(r.keep), r.n, tuple(float(r[f"t{k}"] or 0) for k in range(len(rules)))) for r in sums.collect()]


def cascade(seen, rules=RULES) -> list[tuple[Rule, float, float]]:
    """(rule, share that it rejects of what those before it keep, nanoseconds a row there), in the order of the greedy choice; ties by name."""
    left, out = list(seen), []
    rest = set(range(len(rules)))
    while rest:
        n = sum(m for _, m, _ in left)
        share = {k: sum(m for v, m, _ in left if not v[k]) / n if n else 0.0 for k in rest}
        cost = {k: max(sum(t[k] for _, _, t in left) / n, 1.0) if n else 1.0 for k in rest}
        # of those that reject nothing more, the cheap ones go first
        best = min(rest, key=lambda k: (-share[k] / cost[k], cost[k], rules[k].name))
        out.append((rules[best], share[best], cost[best]))
        left = [x for x in left if x[0][best]]
        rest.remove(best)
    return out


def ordered(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000, repeats: int = 3) -> list[tuple[Rule, float, float]]:
    """cascade() of about sample_rows rows of docs (a random share; which ones changes the order only)."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    return cascade(observed(measures(docs.sample(share, 7) if share < 1 else docs, id_col, text_col), rules, repeats), rules)


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, sample_rows: int = 1000) -> DataFrame:
    """doc_id, the base figures, base_failed and kept, for every row.

    base_failed: fewer than min_words words, or over half of them in repeated windows. kept: neither base nor any rule
    rejects. Null and empty texts fail. Ids are carried only: nulls and repeats are judged row by row.
    """
    verdict = F.lit(True)
    for r, _, _ in reversed(ordered(docs, rules, id_col, text_col, sample_rows)):
        verdict = F.when(F.coalesce(F.expr(r.keep), F.lit(False)), verdict).otherwise(F.lit(False))
    failed = F.expr(f"n_words < {min_words} or 100 * n_repeat_words > 50 * n_words")
    m = measures(docs, id_col, text_col).withColumn("base_failed", failed)
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict).alias("kept"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document judged by the base rules and the cascade."""
    return judge(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 5 * n_symbols <= n_words
       AND 2 * n_dup_lines <= len(string_split(text, chr(10)))
       AND 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) <= word_chars
       AND 2 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= word_chars AND len(list_distinct(words)) >= 15 AS kept
FROM b
"""
