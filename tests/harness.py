"""Runs queries and their SQL side by side on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sampled_response preference_pair step_judgment conversation_record packing_sample dataset_registry reward_criteria eval_items".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    """A value that compares equal across engines."""
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "quantize"):
        return plain(float(x))
    return x


def differences(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs between a query's rows and its SQL's; None if nothing does."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    cursor = con.execute(sql)
    columns = [x[0] for x in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    order = [columns.index(c) for c in names]
    want = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    key = lambda r: [(v is None, str(v)) for v in r]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for x, y in zip(a, b):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5):
                return f"{dict(zip(names, a))} and {dict(zip(names, b))}"[:1500]
    return None
