"""Markdown entries with a YAML head: reader and writer."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:
    yaml = None

# The fields of an entry.
LISTS = ("mood", "entities", "people", "tags", "topic", "links", "related_entries")
SCALARS = ("title", "date", "location", "weather", "project", "abstract", "summary")
SCHEMA = "rel_path string, " + ", ".join(f"{c} string" for c in SCALARS) + ", " + ", ".join(f"{c} array<string>" for c in LISTS) + ", body string, extra map<string,string>"


def plain_head(text: str) -> dict:
    """Where there is no YAML library: `key: value` lines, [a, b] lists and indented `- item` lists of strings."""
    out: dict = {}
    key = None
    bare = lambda v: v.strip().strip("'\"")
    for line in text.splitlines():
        if line.lstrip().startswith("- ") and key is not None:
            out[key] = [*(out[key] or []), bare(line.lstrip()[2:])]
        elif ":" in line and not line.startswith((" ", "#")):
            key, _, v = line.partition(":")
            key, v = key.strip(), v.strip()
            out[key] = [bare(x) for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") and v.endswith("]") else bare(v) or None
    return out


#: A head: a line of three dashes, lines up to the next such line. Dashes within a value don't end it.
_HEAD = re.compile(r"\A\ufeff?---[ \t]*\r?\n(?P<head>.*?)^---[ \t]*\r?$\n?(?P<body>.*)\Z", re.DOTALL | re.MULTILINE)


def parse(text: str) -> tuple[dict, str]:
    """(head, body). Text without a closed head is all body. A head that is no YAML mapping is read line by line, so that what can be read of
    old heads (unquoted colons, stray tabs) is kept.
    """
    found = _HEAD.match(text)
    if not found:
        return {}, text
    head = None
    if yaml:
        try:
            head = yaml.safe_load(found["head"])
        except (ValueError, yaml.YAMLError):
            head = None
    return head if isinstance(head, dict) else plain_head(found["head"]), found["body"].strip()


def entry(path: str, text: str) -> dict:
    """One row: scalars become one-element lists where a list is due; unknown keys go to extra."""
    head, body = parse(text)
    show = lambda v: v if isinstance(v, str) else v.isoformat() if hasattr(v, "isoformat") else json.dumps(v, ensure_ascii=False, default=str)
    row = {"rel_path": path, "body": body}
    for c in SCALARS:
        v = head.get(c)
        row[c] = None if v is None else show(v)
    for c in LISTS:
        v = head.get(c)
        row[c] = [] if v is None else [show(x) for x in (v if isinstance(v, list) else [v])]
    row["title"] = row["title"] or next((x[2:].strip() for x in body.splitlines() if x.startswith("# ")), path.rpartition("/")[2].rpartition(".")[0])
    row["extra"] = {str(k): show(v) for k, v in head.items() if k not in SCALARS and k not in LISTS and v is not None}
    return row


def read_entries(spark: SparkSession, pattern: str) -> DataFrame:
    """Entries of all files that match; one row per file, parsed where it is read; year and month come from the date."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(frames):
        for f in frames:
            yield pd.DataFrame([entry(p, v) for p, v in zip(f["path"], f["value"], strict=True)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA).withColumns({"year": F.substring("date", 1, 4).try_cast("int"), "month": F.substring("date", 6, 2).try_cast("int")})


def write_entries(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Entries as Parquet by year and month."""
    entries.repartition("year", "month").write.mode(mode).partitionBy("year", "month").parquet(path)


class BadGraph(ValueError):
    """What is wrong with an entity graph, one line each."""


def read_graph(spark: SparkSession, text: str) -> DataFrame:
    """A YAML entity graph as nodes with nested relationships. Entities need an id and a name, ids and names are unique, targets exist."""
    given = (yaml.safe_load(text) or {}).get("entities") or []
    ids, names, wrong = [e.get("id") for e in given], {}, []
    for k, e in enumerate(given):
        wrong += [f"entities[{k}] has no {c}" for c in ("id", "primary_name") if not e.get(c)]
        wrong += [f"{e.get('id')}: id is used twice"] if ids.count(e.get("id")) > 1 else []
        for n in {str(n).lower() for n in (e.get("primary_name"), *(e.get("aliases") or [])) if n}:
            if names.setdefault(n, e.get("id")) != e.get("id"):
                wrong.append(f"{e.get('id')}: name {n} is that of {names[n]}")
        wrong += [f"{e.get('id')}: target {r.get('target')} is unknown" for r in e.get("relationships") or [] if r.get("target") not in ids]
    if wrong:
        raise BadGraph("\n".join(wrong))
    rows = [{"id": e["id"], "type": e.get("type"), "primary_name": e["primary_name"], "aliases": list(e.get("aliases") or []), "relationships": [{"target": r["target"], "relation": r["relation"]} for r in e.get("relationships") or []]} for e in given]
    return spark.createDataFrame(rows, "id string, type string, primary_name string, aliases array<string>, relationships array<struct<target:string,relation:string>>")
