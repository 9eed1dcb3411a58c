"""Typed observations in an entry's fields and body: weight, sleep, mood, place, project. Each is an array column, in order, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the facts are written in prose.
WEIGHT = (r"(?i)体重[:：]\s*(\d+(?:\.\d+)?)\s*kg", r"(?i)(?:weight|weighed)\s+(?:measured\s+)?(?:at\s+)?(\d+(?:\.\d+)?)\s*kg")
SLEEP = (r"睡了\s*(\d+(?:\.\d+)?)\s*(?:小时|hours?)", r"(?i)(?:slept|sleep)\s+(?:for\s+)?(?:about\s+)?(?:only\s+)?(\d+(?:\.\d+)?)\s*hours?")
PLACE = (r"在[ \t]*([A-Za-z][A-Za-z']*|[\x{4e00}-\x{9fff}]{2,}?)[ \t]*(?:的|里|看|工作|讨论|散步|第二|最后|一晚|咖啡馆|办公室|园林)", r"(?:in|at)[ \t]+([A-Z][a-zA-Z']*(?:[ ]+[A-Z][a-zA-Z']*)*)")
PROJECT = r"([A-Z][a-zA-Z0-9_-]+)[ \t]*(?:项目|project|roadmap|路线图)"
NO_PROJECT = ("Side", "The", "A", "An", "My", "Our", "This", "That")
NO_PROJECT_TAG = ("dev", "work", "hobby", "milestone", "holiday", "family", "bugfix", "planning", "wrap-up", "release", "travel")
FACES = {"🎉": "celebratory", "😰": "stressed", "🚀": "excited", "🎄": "festive", "😞": "sad", "😊": "happy", "😢": "sad", "😠": "angry", "😴": "sleepy", "🤔": "pensive"}
MOODS = ("stressed", "happy", "sad", "tired", "excited", "calm", "joyful", "melancholy", "grateful", "neutral", "warm")


def _listed(value: Column) -> Column:
    return F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.array(F.trim(value))).otherwise(F.array().cast("array<string>"))


def numbers(value: Column, body: Column, patterns) -> Column:
    """The field's number, then those of the body by each pattern; repeats count."""
    own = F.when(value.try_cast("double").isNotNull(), F.array(value.try_cast("double"))).otherwise(F.array().cast("array<double>"))
    said = [F.transform(F.regexp_extract_all(body, F.lit(p), 1), lambda x: x.cast("double")) for p in patterns]
    return F.concat(own, *said)


def weights(value: Column, body: Column) -> Column:
    return numbers(value, body, WEIGHT)


def sleep(value: Column, body: Column) -> Column:
    return numbers(value, body, SLEEP)


def moods(listed: Column, body: Column) -> Column:
    """Moods of the field, of faces in the body, then mood words that the body holds."""
    own = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    faces = F.array_compact(F.array(*(F.when(body.contains(f), m) for f, m in FACES.items())))
    words = F.array_compact(F.array(*(F.when(F.lower(body).contains(w), w) for w in MOODS)))
    return F.concat(own, F.array_distinct(F.array_except(F.concat(faces, words), own)))


def places(value: Column, body: Column) -> Column:
    said = [F.transform(F.regexp_extract_all(body, F.lit(p), 1), lambda x: F.trim(x)) for p in PLACE]
    return F.array_distinct(F.filter(F.concat(_listed(value), *said), lambda x: x != ""))


def projects(value: Column, tags: Column, body: Column) -> Column:
    """The field, tags that aren't general ones, then names before `project` in the body, three letters or more."""
    own = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(*NO_PROJECT_TAG))
    said = F.filter(F.transform(F.regexp_extract_all(body, F.lit(PROJECT), 1), lambda x: F.trim(x)), lambda x: (F.length(x) >= 3) & ~x.isin(*NO_PROJECT))
    return F.array_distinct(F.concat(_listed(value), own, said))


def heading(body: Column) -> Column:
    """The text of the first `# ` line; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(body, r"(?m)^# (.+)$", 1)), F.lit(""))


def first_paragraph(body: Column) -> Column:
    """The first block of lines that isn't blank and doesn't start with #."""
    blocks = F.filter(F.transform(F.split(body, r"\n[ \t]*\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.coalesce(F.get(blocks, F.lit(0)), F.lit(""))
