"""Compares queries with their SQL over the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(pdf) -> list[tuple]:
    names = sorted(pdf.columns)

    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(plain(v) for v in r) for r in pdf[names].itertuples(index=False)), key=repr)


def difference(spark_pdf, duck_pdf) -> str:
    """Empty if both hold the same rows."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} and {sorted(duck_pdf.columns)}"
    a, b = rows(spark_pdf), rows(duck_pdf)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b, strict=True):
        if x != y and not all(u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9) for u, v in zip(x, y, strict=True)):
            return f"{x} and {y}"
    return ""
