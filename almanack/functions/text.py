"""Column functions; all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import functions as F


def tokens(col):
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+"), 0)


def title(col, limit: int = 50):
    """The first line with something on it, at most `limit` characters."""
    return F.substring(F.trim(F.coalesce(F.get(F.filter(F.split(col, "\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))), 1, limit)


def abstract(col, limit: int = 100):
    """White space folded, at most `limit` characters."""
    return F.substring(F.trim(F.regexp_replace(col, r"[ \t\n\r]+", " ")), 1, limit)


def word_count(col):
    """One per CJK, Kana or Hangul character plus runs of ASCII letters and digits; white-space words where there are none such."""
    cjk = "[぀-ヿ㐀-䶿一-鿿가-힯]"
    mixed = F.size(F.regexp_extract_all(col, F.lit(cjk), 0)) + F.size(F.regexp_extract_all(col, F.lit("[A-Za-z0-9]+"), 0))
    return F.when(col.rlike(cjk), mixed).otherwise(F.size(F.regexp_extract_all(col, F.lit(r"[^ \t\n\r]+"), 0))).cast("long")


def token_match(col, token: str):
    """ASCII tokens match at word edges, others anywhere; lower-cased."""
    token = token.lower()
    if token.isascii() and token.isalnum():
        return F.lower(col).rlike(f"(?<![a-z0-9]){token}(?![a-z0-9])")
    return F.lower(col).contains(token)


def minutes_of_day(value):
    """HH:MM or HH:MM:SS text, or a number (up to 1439 minutes, else seconds), to minutes; null if it is neither."""
    number = F.try_to_number(value, F.lit("999999")).cast("int")
    clock = F.when(value.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"), F.split(value, ":")[0].cast("int") * 60 + F.split(value, ":")[1].cast("int"))
    return F.when(value.contains(":"), clock).otherwise(F.when(number <= 1439, number).otherwise(F.when(number < 86400, F.floor(number / 60)))).cast("int")


def iso_week(col):
    """2024-W05"""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), col).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(col).cast("string"), 2, "0"))


def bucket(col, unit: str):
    """Key of the calendar bucket: day, week (ISO) or month."""
    return {"day": lambda: F.date_format(col, "yyyy-MM-dd"), "week": lambda: iso_week(col), "month": lambda: F.date_format(col, "yyyy-MM")}[unit]()


def fingerprint(version: str, *cols):
    """SHA-256 of a version and fields, parted by NUL."""
    return F.sha2(F.concat_ws("\u0000", F.lit(version), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def paged_digest(rows, groups: list[str], key: str, fanout: int = 1024, levels: int = 3, value: str | None = None):
    """groups, n, digest: SHA-256 of each group's whole-number keys (or a value of each) in their order, page by page: a page has `fanout` keys, a page above it
    `fanout` pages, so lists stay short up to fanout ** levels keys in a row."""
    joined = lambda value: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("_k").alias("k"), value.alias("v")))), lambda x: x["v"]), ","), 256)
    out = rows.select(*groups, F.col(key).cast("long").alias("_k"), F.col(value or key).cast("string").alias("_v"), F.lit(1).cast("long").alias("_n"))
    for level in range(levels):
        page = [F.floor(F.col("_k") / fanout).cast("long").alias("_p")] if level < levels - 1 else []
        out = out.groupBy(*groups, *page).agg(joined(F.col("_v")).alias("_v"), F.sum("_n").alias("_n"))
        out = out.withColumnRenamed("_p", "_k") if page else out
    return out.select(*groups, F.col("_n").alias("n"), F.col("_v").alias("digest"))


def similarity(a, b):
    """1 - Levenshtein distance / length of the longer."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def degrees(d, m, s, ref):
    """Degrees, minutes, seconds to decimal degrees; south and west are negative."""
    return (d + m / 60 + s / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def safe_name(col):
    """A name for use as a file name: reserved characters become underscores."""
    return F.regexp_replace(F.trim(col), r'[\\/:*?"<>|\s]+', "_")


def decayed(n, k: float = 0.1):
    """Weight of a term that n things share: 1 / (1 + k (n - 1)^2)."""
    return 1 / (1 + k * (n - 1) * (n - 1))


#: What may wrap a query, and punctuation at its ends.
WRAPPERS, ENDS = "“”‘’「」『』《》〈〉【】（）［］｛｝", "!！?？,，.。;；:：、…·"


def normalized(col):
    """A query in compatibility form (NFKC), without wrappers and punctuation at its ends, white space folded. One batch of Arrow at a time."""
    import unicodedata

    @F.pandas_udf("string")
    def compatible(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    clean = lambda c, chars: F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")
    base = F.trim(F.regexp_replace(compatible(F.coalesce(col, F.lit(""))), r"^\s+|\s+$", ""))
    return F.trim(F.regexp_replace(clean(clean(base, WRAPPERS), ENDS), r"\s+", " "))


def json_list(col):
    """A JSON array of strings, or else the parts between commas."""
    return F.coalesce(F.from_json(col, "array<string>", {"mode": "PERMISSIVE"}), F.transform(F.split(col, ","), lambda x: F.trim(x)))


#: Python's white space, and the digits that aren't decimal ones (superscripts, circled and so on), for classes of Java and RE2.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
DIGIT = r"\p{Nd}\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
# What tells a query of negation or of a topic outside, in this order.
NEGATIONS = ("不存在", "不相关", "完全不相关", "随机内容", "无关内容")
OFF_TOPIC = ("菜谱", "健身", "减肥", "区块链", "养猫", "养狗", "宠物", "旅行攻略", "旅游攻略")
#: A product's own name, which near misses of count as noise.
CANONICAL = "open almanack"


def noise(col):
    """Why a query is noise, by the first of eight ordered rules that holds, or 'none'; advisory only."""
    q = F.regexp_replace(F.coalesce(col, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    solid = F.regexp_replace(q, " ", "")
    latin = ~q.rlike(r"[\x{4e00}-\x{9fff}]")
    has = lambda signals: q.rlike("|".join(signals))
    low = F.lower(q)
    alike = 1 - F.levenshtein(low, F.lit(CANONICAL)) / F.greatest(F.length(q), F.lit(len(CANONICAL)))
    near = q.rlike(r"^[\x00-\x7f]+$") & (F.abs(F.length(q) - len(CANONICAL)) <= 2) & (alike >= 0.65) & (alike < 0.85)
    return (
        F.when(q == "", "empty_query")
        .when(q.rlike(rf"^[\p{{P}}{SPACE}]+$"), "pure_symbols")
        .when(q.rlike(f"^[{DIGIT}]+$"), "pure_digits")
        .when(F.replace(q, F.substring(q, 1, 1), F.lit("")) == "", "repeated_char")
        .when(F.length(F.regexp_replace(q, rf"[\p{{P}}{SPACE}]", "")) < 3, "too_short")
        .when(latin & solid.rlike(r"^[\p{L}\p{N}]+$") & (2 * F.length(F.regexp_replace(solid, f"[^{DIGIT}]", "")) >= F.length(solid)), "alphanumeric_noise")
        .when(latin & ~q.rlike("[a-zA-Z]{3}"), "no_dictionary_words")
        .when(has(NEGATIONS), "negation_intent")
        .when(has(OFF_TOPIC), "ood_topic")
        .when(near, "typo_near_noise")
        .otherwise("none")
    )
