"""Order-insensitive comparison of a Spark result with its SQL oracle (used by tests and tools)."""

from __future__ import annotations

import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def spark_rows(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(tuple(_plain(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def difference(df, con, sql: str) -> str | None:
    """``None`` when both sides agree, otherwise a short description."""
    cols, left = spark_rows(df)
    ocols, right = duck_rows(con, sql)
    if cols != ocols:
        return f"columns differ: {cols} vs {ocols}"
    if left == right:
        return None
    only_l, only_r = list((left - right).items())[:3], list((right - left).items())[:3]
    return (
        f"{sum(left.values())} vs {sum(right.values())} rows, {sum((left - right).values())} differ; {cols}\n"
        f"  spark only: {only_l}\n  oracle only: {only_r}"
    )
