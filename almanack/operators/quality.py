"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, rules: dict[str, object], id_col: str = "doc_id") -> DataFrame:
    """id, issue: one row per broken rule. All rules are evaluated in one pass."""
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return rows.select(id_col, F.explode(found).alias("issue"))


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, href of every link."""
    return pages.select(id_col, F.explode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), 1)).alias("href"))


def text_flags(rows: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Byte-order mark, signs of wrong decoding, absolute local paths, key-like tokens."""
    t = F.col(text)
    return rows.select(id_col, t.startswith("﻿").alias("has_bom"), t.rlike("Ã©|Ã¨|â€|ï¿½").alias("mojibake"), t.rlike(r"(/home/|/Users/|[A-Z]:\\)").alias("local_path"), t.rlike(r"(ghp_[A-Za-z0-9]{20}|sk-[A-Za-z0-9]{20})").alias("key_like"))
