"""Compare a registered query with its SQL, as multisets of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [_cell(x) for x in v]
    try:
        return round(float(v), 6) if not isinstance(v, int) else v
    except (TypeError, ValueError):
        return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([_cell(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a text that shows the difference."""
    df = fn(spark, sf_dir)
    res = con.sql(sql)
    if sorted(df.columns) != sorted(res.columns):
        return f"columns {sorted(df.columns)} vs {sorted(res.columns)}"
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    right = rows_of(res.columns, res.fetchall())
    if left == right:
        return None if left else "EMPTY"
    from collections import Counter
    a, b = Counter(left), Counter(right)
    return f"{len(left)} vs {len(right)} rows; spark only {list((a - b))[:3]}; sql only {list((b - a))[:3]}"
