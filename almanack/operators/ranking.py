"""Tiered ranking of content, metadata and index matches, with promotion, confidence, reasons and snippets.

All tiers are columns of the same entries, so one projection scores them: no join, no shuffle before the final order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import written

# Points and bounds of the score scale.
TITLE_HIT, LINE_HIT, MOST_CONTENT, LEAST_CONTENT = 40, 10, 80, 15
TIER3_TITLE, TIER2_BASE, TIER1_BASE = 10, 30, 10
BONUS_TITLE, BONUS_ABSTRACT, BONUS_TAG, BONUS_LOCATION, BONUS_ENTITY, BONUS_STARTS, BONUS_HOLDS = 8, 4, 3, 15, 6, 10, 3
TOPIC_FACTOR, INTENT_BONUS, PROMOTION = 1.1, 50, 1.5
RICH, STANDARD, BASIC = 1.08, 1.04, 1.0
LEAST_RELEVANCE, LEAST_FREQUENT, LEAST_OTHER, MEDIUM = 25, 50, 10, 50
SNIPPET_TOKENS = 32
STOP_LETTERS = "的了在是我有和就不人都一上也很到说要去你会着看好这那他她它们哪谁几起过来把被让给对向从往于为与以比同跟连除并且则而及但再亦即若如其各每某该本全略真太挺还仍已未尚先后前？！。，、；：得做吗呢吧啊呀么a"


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def content(e: DataFrame, phrase: str) -> DataFrame:
    """Adds title_match, n_lines (lines of the body with the phrase) and relevance (0 to 80) of a plain content match."""
    p = phrase.lower()
    lines = F.when(F.lower("body").contains(p), F.size(F.filter(F.split("body", "\n"), lambda x: F.lower(x).contains(p)))).otherwise(0)
    e = e.withColumns({"title_match": F.coalesce(F.lower("title").contains(p), F.lit(False)), "n_lines": F.coalesce(lines, F.lit(0))})
    return e.withColumn("relevance", F.least(F.lit(MOST_CONTENT), F.when(F.col("title_match"), TITLE_HIT).otherwise(0) + LINE_HIT * F.least("n_lines", F.lit(3))))


def metadata_hit(tokens: list[str]) -> Column:
    """Any token in title, abstract, a tag or the location."""
    return any_of(F.coalesce(T.token_match(F.col(c), t), F.lit(False)) | F.exists("tags", lambda x: T.token_match(x, t)) for t in tokens for c in ("title", "abstract", "location"))  # noqa: B023


def metadata_points(query: str, entity_terms=()) -> Column:
    """Bonus of a metadata match: tokens by place, location once, the whole phrase in the title, entity terms once."""
    tokens = query.split() if len(query.split()) > 1 else [query]
    hit = lambda c, t: F.coalesce(T.token_match(F.col(c), t), F.lit(False))
    points = F.lit(0)
    for t in tokens:
        for c, v in (("title", BONUS_TITLE), ("abstract", BONUS_ABSTRACT)):
            points = points + F.when(hit(c, t), v).otherwise(0)
        points = points + F.when(F.exists("tags", lambda x: T.token_match(x, t)), BONUS_TAG).otherwise(0)  # noqa: B023
    points = points + F.when(any_of(hit("location", t) for t in tokens), BONUS_LOCATION).otherwise(0)
    if len(tokens) > 1:
        points = points + F.when(F.startswith(F.lower("title"), F.lit(query.lower())), BONUS_STARTS).when(F.lower("title").contains(query.lower()), BONUS_HOLDS).otherwise(0)
    if entity_terms:
        listed = F.arrays_overlap(F.array_union("people", "tags"), F.array(*map(F.lit, entity_terms)))
        said = F.lower(F.concat_ws(" ", "title", "abstract"))
        points = points + F.when(F.coalesce(listed, F.lit(False)) | any_of(said.contains(t.lower()) for t in entity_terms), BONUS_ENTITY).otherwise(0)
    return points


def scored(e: DataFrame, query: str, entity_terms=(), topic_hints=(), since: str | None = None, until: str | None = None, listed: Column | None = None, by_source: bool = False) -> DataFrame:
    """Entries that any tier finds, with tier and score.

    Tier 3: content; 2: metadata; 1: those that `listed` names. Then, in this order: topics that are hinted at (a factor),
    date and topic both asked for (a bonus), and the richness of the entry's own metadata (a factor, if by_source).
    """
    e = content(e, query)
    tokens = query.split() if len(query.split()) > 1 else [query]
    two, points = metadata_hit(tokens), metadata_points(query, entity_terms)
    tier = F.when(F.col("relevance") >= LEAST_CONTENT, 3).when(two, 2).when(listed if listed is not None else F.lit(False), 1)
    e = e.withColumn("tier", tier.cast("long")).filter("tier is not null")
    base = F.when(F.col("tier") == 3, F.col("relevance") + F.when(F.col("title_match"), TIER3_TITLE).otherwise(0) + F.when(two, points).otherwise(0)).when(F.col("tier") == 2, TIER2_BASE + points).otherwise(TIER1_BASE)
    score = base.cast("double")
    if topic_hints:
        hinted = F.coalesce(F.col("topic").isin(list(topic_hints)), F.lit(False))
        score = score * F.when(hinted, TOPIC_FACTOR).otherwise(1.0)
        if since and until:
            score = score + F.when(hinted & F.col("date").between(since, until), INTENT_BONUS).otherwise(0)
    if by_source:
        more = (F.size("people") > 0) | (F.size("tags") > 0)
        score = score * F.when(F.col("topic").isNotNull() & more, RICH).when(F.col("topic").isNotNull() | more, STANDARD).otherwise(BASIC)
    return e.withColumn("score", F.round(score, 4))


def fence(scores: DataFrame, base: float = LEAST_RELEVANCE, least: int = 8) -> DataFrame:
    """One row, fence: first quartile less 1.5 spreads, base at least; base for fewer than `least` scores or no spread.

    Quartiles are the values at places n / 4 and 3 n / 4 from 0 on, read off the counts of different scores.
    """
    c = scores.filter("score > 0").groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumns({"upto": F.sum("c").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy())})
    q = c.agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 4), F.col("score"))).alias("q1"), F.min(F.when(F.col("upto") > F.floor(3 * F.col("n") / 4), F.col("score"))).alias("q3"))
    low = F.when((F.col("n") >= least) & (F.col("q3") > F.col("q1")), F.greatest(F.lit(float(base)), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))))
    return q.select("n", "q1", "q3", F.round(F.coalesce(low, F.lit(float(base))), 4).alias("fence"))


def passing(s: DataFrame, base: float = LEAST_RELEVANCE) -> DataFrame:
    """Rows of scored() above their tier's threshold: the fence for content, a fixed one for the others."""
    return s.crossJoin(F.broadcast(fence(s.select("score"), base).select("fence"))).filter((F.col("tier") < 3) & (F.col("score") >= LEAST_OTHER) | (F.col("tier") == 3) & (F.col("score") >= F.col("fence"))).drop("fence")


def placed(rows: DataFrame, score: str, name: str, *ties) -> DataFrame:
    """Adds name = 1, 2, ... by falling score, then ties. Counts of the different scores give each score's first place, so
    only rows of one score are sorted by one task.
    """
    counts = rows.groupBy(score).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(score, before.alias("before"))
    own = F.row_number().over(Window.partitionBy(score).orderBy(*ties))
    return rows.withColumn("own", own).join(first, score).withColumn(name, (F.col("before") + F.col("own")).cast("long")).drop("own", "before")


def promoted(query: str, title: str = "title") -> Column:
    """Three letters or more of the query aren't stop letters, and the title holds 60 % of them or more, each occurrence counted."""
    letters = [c for c in query if c.strip() and c not in STOP_LETTERS]
    if len(letters) < 3:
        return F.lit(False)
    held = sum((F.lower(title).contains(c.lower()).cast("int") for c in letters), F.lit(0))
    return F.coalesce(held >= 0.6 * len(letters), F.lit(False))


def confidence(content_score: Column) -> Column:
    """Without semantic scores only medium and low can be had."""
    return F.when(content_score >= MEDIUM, "medium").otherwise("low")


def reason(is_promoted: Column, content_score: Column) -> Column:
    """Why a result stands where it does (fixed wording)."""
    said = F.concat_ws("；", F.when(is_promoted, "标题命中查询词（+1.5x 置顶）"), F.when(content_score > 0, F.concat(F.lit("关键词 FTS="), F.format_string("%.2f", content_score.cast("double")))))
    return F.when(said == "", "元数据匹配（弱信号）").otherwise(said)


def ranked(s: DataFrame, query: str, base: float = LEAST_RELEVANCE) -> DataFrame:
    """Rows of scored() that pass, with search_rank, promoted, final_score, confidence, reason and final_rank.

    search_rank: score, tier, place of the phrase in the title, id. Promotion multiplies the score and sorts again, so that equal
    scores stay in the order they had. Confidence doesn't change by promotion.
    """
    # texts are scored once: thresholds and places need the scores several times
    s = written(s.select("doc_id", "title", "tier", "score", "relevance"), "scored")
    at = F.locate(query.lower(), F.lower("title"))
    rows = placed(passing(s, base).withColumn("at", F.when(at > 0, at - 1).otherwise(9999)), "score", "search_rank", F.desc("tier"), "at", "doc_id").drop("at")
    hit = F.when(F.col("tier") == 3, F.col("relevance")).otherwise(0)
    rows = rows.withColumns({"promoted": promoted(query), "confidence": confidence(hit)})
    rows = rows.withColumns({"final_score": F.round(F.col("score") * F.when(F.col("promoted"), PROMOTION).otherwise(1.0), 4), "reason": reason(F.col("promoted"), hit)})
    return placed(rows, "final_score", "final_rank", "search_rank")


def no_confident_match(rows: DataFrame, by: str) -> DataFrame:
    """by, no_confident_match: content was found but nothing of it is medium or better, or none was found (without content, medium isn't enough).

    rows: by, content_score, confidence.
    """
    return rows.groupBy(by).agg((~F.bool_or((F.col("content_score") > 0) & F.col("confidence").isin("medium", "high"))).alias("no_confident_match"))


def least_relevance(query: Column, frequent: list[str], given: int = LEAST_RELEVANCE) -> Column:
    """The threshold of a query: a stricter one where it holds a term that is frequent in the corpus; a given one stands."""
    if given != LEAST_RELEVANCE:
        return F.lit(given)
    said = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    return F.when(any_of(said.contains(t) for t in frequent), LEAST_FREQUENT).otherwise(LEAST_RELEVANCE)


def snippet(body: Column, terms: list[str], tokens: int = SNIPPET_TOKENS) -> Column:
    """The window of `tokens` words with most different terms (the first of them), each hit within <mark>, cut ends shown by an ellipsis.

    Windows start at hits, or earlier where the text ends. Null without a hit.
    """
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")

    def window(ws):
        hits = F.filter(F.transform(ws, lambda w, i: F.when(bare(w).isin(terms), F.greatest(F.lit(0), F.least(i, F.size(ws) - tokens)))), lambda x: x.isNotNull())
        ranks = F.transform(F.array_distinct(hits), lambda a: F.struct((-F.size(F.array_intersect(F.transform(F.slice(ws, a + 1, tokens), bare), F.array(*map(F.lit, terms))))).alias("less"), a.alias("at")))
        return F.array_min(ranks)["at"]

    def shown(ws, a):
        part = F.transform(F.slice(ws, a + 1, tokens), lambda w: F.when(bare(w).isin(terms), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
        return F.concat(F.when(a > 0, "...").otherwise(""), F.array_join(part, " "), F.when(a + tokens < F.size(ws), "...").otherwise(""))

    return F.get(F.transform(F.array(words), lambda ws: F.get(F.transform(F.array(window(ws)), lambda a: shown(ws, a)), F.lit(0))), F.lit(0))


def augmented(found: DataFrame, entries: DataFrame, since: str, until: str, topics: list[str], keywords: list[str]) -> DataFrame:
    """doc_id, source: what was found, and entries of the dates and topics asked for (or of the dates alone, where nothing else is asked for)."""
    if topics:
        more = entries.filter(F.col("date").between(since, until) & F.col("topic").isin(topics))
    elif not keywords:
        more = entries.filter(F.col("date").between(since, until))
    else:
        more = entries.limit(0)
    both = found.select("doc_id", F.lit(1).alias("k")).unionByName(more.select("doc_id", F.lit(2).alias("k")))
    return both.groupBy("doc_id").agg(F.when(F.min("k") == 1, "keyword").otherwise("structured_metadata").alias("source"))
