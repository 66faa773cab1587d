"""Run a registered query and its SQL counterpart and compare them as unordered rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, decimal.Decimal)):
        return f"{float(x):.10g}"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.10g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    """None when equal, else a description of the difference."""
    df = fn(spark, sf)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows vs {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{name}: {g} vs {w}"
    return None
