"""URL rules by a sort-merge range join: reversed-host keys make prefixes intervals, a sorted sweep finds the innermost.

A rule (host, path) fits its host and all subdomains where the URL's path starts with its own. Its canonical key is the
reversed host, a slash and the path (`org.example//es/` for example.org/es/), and the keys that start with it are one interval. A URL
is looked up once for each of its last 1, 2, ... host labels, so that subdomains need no rule of their own; rules bound
the number of labels. The rules' interval ends are sorted and swept with a stack of active (nested) rules, which yields
disjoint segments, each with its innermost rule. URLs and segment starts are sorted together and each URL takes the last
segment start at or before its key.

DataFrame functions only. Rows are dealt by a hash of the whole URL and page id over salts that each hold the segments, so a
host with a third of all rows is spread evenly; one shuffle of URLs, without page contents. With more than `bucket_rules`
rules, segments and URLs are cut into ranges of keys first, at starts of segments, and each range has its salts, so that
no task holds more than a range's segments; URLs are then shuffled once for each number of labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: Greater than any text that starts with the same characters.
_END = "\U0010ffff" * 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url):
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.when(url.contains("://"), F.expr("substring(__u, locate('://', __u) + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    """From the first / after the host up to ?, # or the end; empty for null or no ://."""
    rest = F.when(url.contains("://"), F.expr("substring(__u, locate('://', __u) + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(labels):
    return F.concat_ws(".", F.reverse(labels))


def rule_segments(rules: DataFrame) -> DataFrame:
    """(labels, start, rule, prefix, verdict) of disjoint segments: from start on, up to the next start, rule is the innermost."""
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path")
    r = rules.select(
        "host",
        F.size(F.split("host", r"\.")).alias("labels"),
        F.concat(_reversed(F.split("host", r"\.")), F.lit("/"), F.col("path")).alias("prefix"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    # equal rules: block wins
    r = r.groupBy("labels", "host", "prefix").agg(F.max_by(F.struct("rule", "verdict"), F.col("verdict")).alias("r")).select("labels", "host", "prefix", "r.rule", "r.verdict")
    # rules nest within one host only, so each host is swept by itself
    one = lambda at, opens: F.struct(at.alias("at"), F.lit(opens).alias("opens"), F.struct("rule", "prefix", "verdict").alias("r"))
    event = r.select("labels", "host", F.inline(F.array(one(F.col("prefix"), 1), one(F.concat("prefix", F.lit(_END)), -1))))
    # the height of the stack after each event; what is open at a height is the rule that came to it last
    upto = lambda *by: Window.partitionBy(*by).orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, 0)
    swept = event.withColumn("height", F.sum("opens").over(upto("labels", "host")))
    top = F.last(F.when(F.col("opens") == 1, F.col("r")), ignorenulls=True).over(upto("labels", "host", "height"))
    return swept.select("labels", F.col("at").alias("start"), F.when(F.col("height") > 0, top).alias("r"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", bucket_rules: int = 20_000, salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    rules: (verdict, host, path). The longest fitting rule (host and path) wins, `default` where none fits. Null urls and urls
    without :// have an empty host and path. Rows that repeat, or share an id, are judged each; other columns are ignored.
    No rules: every verdict is the default. Hosts of rules count in lower case; of equal rules, block wins.
    """
    spark = pages.sparkSession
    n_rules, deepest = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("host", r"\.")))).first()
    deepest = deepest or 0
    salts = salts or 4 * partitions(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__u"))
    rows = rows.select("page_id", host_of(F.col("__u")).alias("host"), path_of(F.col("__u")).alias("path"), F.pmod(F.xxhash64("page_id", "__u"), F.lit(salts)).alias("salt"))
    label = F.split("host", r"\.")
    keys = [F.when(F.size(label) >= k, F.concat(_reversed(F.slice(label, -k, k)), F.lit("/"), F.col("path"))) for k in range(1, deepest + 1)]
    rows = rows.select("*", *(x.alias(f"k{k}") for k, x in enumerate(keys, 1)))
    bounds: dict[int, list[str]] = {}
    if deepest:
        seg = rule_segments(rules)
        if (buckets := -(-n_rules // bucket_rules)) > 1:  # some starts of segments, a sample of bounded size, as bounds of ranges
            share = min(1.0, 64 * buckets / n_rules)
            some = seg.filter(F.col("r").isNotNull() & (F.xxhash64("start") / F.lit(2.0**64) + 0.5 < share)).select("labels", "start").limit(256 * buckets).collect()
            for k in range(1, deepest + 1):
                starts = sorted({r.start for r in some if r.labels == k})
                bounds[k] = [starts[len(starts) * i // buckets] for i in range(1, buckets)] if len(starts) >= buckets else starts
        # a segment goes to every salt, URLs to one each
        seg = seg.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        seg = seg.select("salt", *(F.when(F.col("labels") == k, F.col("start")).alias(f"k{k}") for k in range(1, deepest + 1)), F.struct("r").alias("segment"))
        rows = rows.unionByName(seg, allowMissingColumns=True)
    for k in range(1, deepest + 1):
        own = F.when(F.col("segment").isNotNull() & F.col(f"k{k}").isNotNull(), F.col("segment"))
        by = ["salt"]
        if bounds.get(k):
            low = F.array(*map(F.lit, bounds[k]))
            rows = rows.withColumn(f"b{k}", F.size(F.filter(low, lambda b: b <= F.col(f"k{k}"))))  # noqa: B023
            by = [f"b{k}", "salt"]
        w = Window.partitionBy(*by).orderBy(F.col(f"k{k}"), F.col("segment").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"r{k}", F.last(own, ignorenulls=True).over(w)["r"])
    rule, verdict = F.lit(None).cast("string"), F.lit(default)
    if deepest:
        fits = [F.when(F.col(f"k{k}").isNotNull() & F.startswith(F.col(f"k{k}"), F.col(f"r{k}.prefix")), F.struct(F.length(f"r{k}.rule").alias("n"), F.lit(k).alias("k"), F.col(f"r{k}.rule").alias("rule"), F.col(f"r{k}.verdict").alias("verdict"))) for k in range(1, deepest + 1)]
        rows = rows.filter(F.col("segment").isNull()).withColumn("best", F.array_max(F.array(*fits)))
        rule, verdict = F.col("best.rule"), F.coalesce("best.verdict", F.lit(default))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the standing rules."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP10_SQL = """
WITH h AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM h),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
