"""Validation, verification, import plans, freshness, and answers with their claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sketches import nearest_rank

# The format of entries.
DATE, LINK, ENTRY_PATH = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$", r"^https?://", r"^Journals/.+\.md$"
LOOSE_COPY = r"^(.+_\d{4}-\d{2}-\d{2}_\d+)_\d{8}_\d{6}_\d{6}(?:_\d+)?\.md$"
REQUIRED, VERSION, MOST_RELATED = ("title", "date"), 1, 10


def validate(e: DataFrame, required=REQUIRED, version: int = VERSION) -> DataFrame:
    """doc_id, level, field, n of each kind of problem. e: doc_id, required columns, date, schema_version, links, related."""
    issue = lambda cond, level, name, n=F.lit(1): F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(name).alias("field"), n.cast("long").alias("n")))
    bad = lambda c, p: F.coalesce(F.size(F.filter(c, lambda x: (x != "") & ~x.rlike(p))), F.lit(0))
    links, related = bad("links", LINK), bad("related", ENTRY_PATH)
    all_of = [
        *(issue(F.coalesce(F.col(c), F.lit("")) == "", "error", c) for c in required),
        issue((F.col("date") != "") & ~F.col("date").rlike(DATE), "warning", "date"),
        issue(F.col("schema_version") != version, "warning", "schema_version"),
        issue(links > 0, "warning", "links", links),
        issue(F.size("related") > MOST_RELATED, "error", "related_count"),
        issue(related > 0, "error", "related_entries", related),
    ]
    return e.select("doc_id", F.explode(F.filter(F.array(*all_of), lambda x: x.isNotNull())).alias("i")).select("doc_id", "i.level", "i.field", "i.n")


def broken_links(pages: DataFrame, id_col: str, text_col: str, url_col: str) -> DataFrame:
    """id, target of links within the site whose target no page has."""
    links = pages.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit('href="(/[^"#?]*)'), 1))).alias("target"))
    known = pages.select(F.regexp_extract(url_col, r"^[^:]+://[^/?#]*(/[^?#]*)", 1).alias("target")).distinct()
    return links.join(known, "target", "left_anti").select(id_col, "target")


def missing_indexes(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """level, key of years and months that have entries and no generated document (level, key)."""
    keys = entries.select(F.explode(F.array(F.struct(F.lit("year").alias("level"), F.date_format("date", "yyyy").alias("key")), F.struct(F.lit("month").alias("level"), F.date_format("date", "yyyy-MM").alias("key")))).alias("k")).select("k.level", "k.key").distinct()
    return keys.join(documents, ["level", "key"], "left_anti")


def loose_copies(files: DataFrame) -> DataFrame:
    """name, canonical, repairable, risk of copies with a time stamp; repairable where the original is there too."""
    c = files.select("name", F.concat(F.regexp_extract("name", LOOSE_COPY, 1), F.lit(".md")).alias("canonical")).filter(F.col("name").rlike(LOOSE_COPY))
    j = c.join(files.select(F.col("name").alias("canonical"), F.lit(True).alias("there")).distinct(), "canonical", "left")
    ok = F.coalesce("there", F.lit(False))
    return j.select("name", "canonical", ok.alias("repairable"), F.when(ok, "low").otherwise("medium").alias("risk"))


def check(name: str, bad: DataFrame, total: DataFrame, worse: str = "warning") -> DataFrame:
    """One row: name, status, count, n_issues."""
    n = bad.agg(F.count(F.lit(1)).alias("n_issues")).crossJoin(F.broadcast(total.agg(F.count(F.lit(1)).alias("count"))))
    return n.select(F.lit(name).alias("name"), F.when(F.col("n_issues") > 0, worse).otherwise("ok").alias("status"), "count", "n_issues")


def together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def plan_problems(plan: DataFrame) -> DataFrame:
    """record_id, problem: content that isn't what its hash says, and targets that several records share. plan: record_id, content, content_hash, target."""
    shared = plan.groupBy("target").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("target")
    drift = plan.filter(F.sha2("content", 256) != F.col("content_hash")).select("record_id", F.lit("hash_mismatch").alias("problem"))
    return drift.unionByName(plan.join(shared, "target", "left_semi").select("record_id", F.lit("target_not_unique").alias("problem")))


def pre_checks(plan: DataFrame, ledger: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """record_id, outcome before an import runs: done before, its source has changed since the plan, its target holds something else, or ready.

    plan: record_id, key, content_hash, target, source_hash; ledger: key; targets: target, hash; sources: record_id, hash.
    """
    p = plan.join(ledger.select("key", F.lit(True).alias("done")).distinct(), "key", "left")
    p = p.join(sources.select("record_id", F.col("hash").alias("now")), "record_id", "left").join(targets.select("target", F.col("hash").alias("held")), "target", "left")
    out = F.when(F.col("done"), "already_imported").when(F.col("now").isNull() | (F.col("now") != F.col("source_hash")), "source_drift").when(F.col("held").isNotNull() & (F.col("held") != F.col("content_hash")), "target_conflict").otherwise("ready")
    return p.select("record_id", out.alias("outcome"))


def rollback(written: DataFrame, now: DataFrame) -> DataFrame:
    """job_id, n, may_roll_back: a job goes back as a whole or not at all, only if every file still has the checksum that it was written with."""
    j = written.join(now.select("target", F.col("hash").alias("now")), "target", "left")
    return j.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("now") == F.col("hash"), F.lit(False))).alias("may_roll_back"))


def cache_state(cache: DataFrame, version: int, source_hash: Column) -> DataFrame:
    """id, would_rebuild, reasons. cache: id, present, version, hash."""
    why = F.array_compact(F.array(F.when(~F.col("present"), "missing"), F.when(F.col("present") & (F.col("version") != version), "version_mismatch"), F.when(F.col("present") & (F.col("hash") != source_hash), "source_changed")))
    return cache.select("id", (F.size(why) > 0).alias("would_rebuild"), F.array_join(why, ",").alias("reasons"))


def pipeline_signal(content: Column, semantic: Column, enabled: Column, warned: Column) -> Column:
    """degraded, hybrid, semantic_only or fts_only, by ordered rules."""
    return F.when(enabled & warned, "degraded").when((content > 0) & (semantic > 0), "hybrid").when(semantic > 0, "semantic_only").when(content > 0, "fts_only").when(enabled, "hybrid").otherwise("fts_only")


def outcome(rows: DataFrame) -> DataFrame:
    """query_id, retrieval_outcome, outcome_reason. rows: query_id, n_items, total, has_more, n_confident (medium or high)."""
    n, more = F.col("n_items"), F.col("has_more")
    kind = F.when((n == 0) & more, "low_confidence_with_potential_under_recall").when((n == 0) & (F.col("total") == 0), "no_matches_found").when((F.col("n_confident") == 0) & (F.col("total") <= n) & ~more, "all_items_low_confidence_full_recall").when(F.col("n_confident") > 0, "confident_results_present").otherwise("low_confidence_with_potential_under_recall")
    said = F.when(kind == "no_matches_found", "zero_results").when(kind == "confident_results_present", "ok").otherwise("weak_results")
    return rows.select("query_id", said.alias("retrieval_outcome"), kind.alias("outcome_reason"))


def claim(predicate: str, n_unknown: Column) -> tuple[Column, Column, Column]:
    """exactness, confidence, claim type of an answer by its predicate; a time of day that some entries lack makes it partial."""
    loose = predicate in ("term_presence", "entity_presence")
    exact = F.lit("approximate") if loose else F.when(n_unknown > 0, "partial").otherwise("exact") if predicate == "entry_time_after" else F.lit("exact")
    return exact, F.lit("medium" if loose else "high"), F.concat(F.lit("measurable_"), exact)


def evidence(roles: DataFrame, bucket: Column, most: int = 20) -> DataFrame:
    """bucket, n_matched, paths: the first `most` ids of the matched entries of each bucket, by id."""
    m = roles.filter("role = 'matched'").select(bucket.alias("bucket"), "doc_id")
    first = m.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))).filter(F.col("k") <= most).groupBy("bucket").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return m.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_matched")).join(first, "bucket").select("bucket", "n_matched", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("paths"))


def ablation(results: DataFrame, relevant: DataFrame, k: int = 5, digits: int = 4) -> DataFrame:
    """combo, precision, recall, mrr at k: means over queries. results: combo, query_id, doc_id, rank; relevant: query_id, doc_id."""
    r = relevant.distinct().withColumn("hit", F.lit(1))
    size = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    top = results.filter(F.col("rank") <= k).join(r, ["query_id", "doc_id"], "left").groupBy("combo", "query_id").agg(F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    j = top.join(size, "query_id", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), digits)
    return j.groupBy("combo").agg(mean(F.col("hits") / k).alias("prec"), mean(F.col("hits") / F.col("size")).alias("recall"), mean(1 / F.col("first")).alias("mrr"))


def diagnosis(log: DataFrame, since: Column, slow: float = 200.0) -> DataFrame:
    """kind, key, n, value of a search log since a time: count, mean, p95 (nearest rank), signals, warnings, queries without a result, the slowest and the degraded.

    log: ts, query, latency_ms, result_count, signal, warnings (array).
    """
    w = log.filter(F.col("ts") >= since)
    row = lambda df, kind, key, n, v: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.cast("long").alias("n"), v.cast("double").alias("value"))
    one = w.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean"), F.countDistinct(F.when(F.col("result_count") == 0, F.col("query"))).alias("none"))
    none = F.lit(None)
    out = [row(one, "mean", F.lit(""), F.col("n"), F.col("mean")), row(one.crossJoin(F.broadcast(nearest_rank(w, "latency_ms"))), "p95", F.lit(""), F.col("n"), F.col("value")), row(one, "zero_result_queries", F.lit(""), F.col("none"), none)]
    for kind, keyed in (("signal", w.select(F.col("signal").alias("k"))), ("warning", w.select(F.explode("warnings").alias("k")))):
        out.append(row(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")), kind, F.col("k"), F.col("n"), none))
    out.append(row(w.filter(F.col("latency_ms") > slow).orderBy(F.desc("latency_ms"), "id").limit(20), "outlier", F.col("id"), F.lit(1), F.col("latency_ms")))
    out.append(row(w.filter("signal = 'degraded'").orderBy("id").limit(10), "degraded", F.col("id"), F.lit(1), none))
    return together(out)


def doctor(tables: list) -> DataFrame:
    """detector, severity, n_found, n_checked, verdict: one report over tables.

    tables: (rows, flags, repeats, missing). flags: detector -> (severity, condition on a row), all in one pass; repeats: detector ->
    (severity, columns), rows beyond the first of equal values, nulls apart; missing: detector -> (severity, column, keys), rows whose key the
    other table's one column hasn't. Found by rule, nothing is repaired.
    """
    out = []
    for rows, flags, repeats, missing in tables:
        row = lambda df, name, severity: df.select(F.lit(name).alias("detector"), F.lit(severity).alias("severity"), F.col("n_found").cast("long").alias("n_found"), F.col("n_checked").cast("long").alias("n_checked"))
        if flags:
            one = rows.agg(F.count(F.lit(1)).alias("n_checked"), *(F.count_if(c).alias(f"f_{k}") for k, (_, c) in flags.items()))
            out.extend(row(one.withColumn("n_found", F.col(f"f_{k}")), k, severity) for k, (severity, _) in flags.items())
        for k, (severity, columns) in repeats.items():
            n = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("more", F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)), F.col("n") - 1).otherwise(0))
            out.append(row(n.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n_found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked")), k, severity))
        for k, (severity, column, keys) in missing.items():
            n = rows.groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
            held = n.join(keys.toDF("_k").distinct().withColumn("held", F.lit(True)), "_k", "left")
            lost = F.when(F.col("held").isNull() & F.col("_k").isNotNull(), F.col("n")).otherwise(0)
            out.append(row(held.agg(F.coalesce(F.sum(lost), F.lit(0)).alias("n_found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked")), k, severity))
    verdict = F.when(F.col("n_found") == 0, "ok").when(F.col("severity") == "high", "blocked").otherwise("review")
    return together(out).withColumn("verdict", verdict)


def switched(rows: DataFrame, signals: list[str], score: str, factor: float = 2.0) -> DataFrame:
    """rows once for each combination of signals (columns of booleans) that is switched on, with combo and boosted: the score times factor for
    each signal that is on and holds."""
    states = F.array(*(F.struct(*(F.lit(bool(k >> i & 1)).alias(s) for i, s in enumerate(signals))) for k in range(2 ** len(signals))))
    out = rows.withColumn("_on", F.explode(states))
    name = F.concat(*(F.when(F.col(f"_on.{s}"), f"+{s}").otherwise(f"-{s}") for s in signals))
    boost = reduce(lambda a, b: a * b, (F.when(F.col(f"_on.{s}") & F.col(s), factor).otherwise(1.0) for s in signals))
    return out.withColumns({"combo": name, "boosted": F.col(score) * boost}).drop("_on")
