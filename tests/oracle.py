"""Rows of a query against rows of its SQL."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return float(v) if isinstance(v, float) else v

    return sorted(repr([one(v) for v in r]) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


def python_rows(names: list[str], found: list) -> list:
    """Rows of Python values in order of column name: whole numbers stay whole beside nulls."""
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i].isoformat() if hasattr(r[i], "isoformat") else r[i] for i in by]) for r in found)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con
