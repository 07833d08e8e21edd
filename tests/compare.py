"""Runs one registered query on Spark and its SQL on DuckDB and compares the row multisets."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return round(float(v), 6) if not isinstance(v, int) else float(v)


def compare(df, con, sql: str) -> str | None:
    """None where both sides agree, else what differs."""
    names = sorted(df.columns)
    rel = con.execute(sql)
    duck_names = [d[0] for d in rel.description]
    if sorted(duck_names) != names:
        return f"columns {names} vs {sorted(duck_names)}"
    at = [duck_names.index(n) for n in names]
    theirs = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    ours = Counter(tuple(norm(v) for v in r) for r in df.select(*names).collect())
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"rows {sum(ours.values())} vs {sum(theirs.values())}; spark only {sum(only_ours.values())}: {list(only_ours)[:2]}; "
        f"duckdb only {sum(only_theirs.values())}: {list(only_theirs)[:2]} columns {names}"
    )
