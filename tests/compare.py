"""Run a registered query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET threads = 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _value(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if hasattr(v, "tolist"):
        return _value(v.tolist())
    if isinstance(v, (list, tuple)):
        return str([_value(x) for x in v])
    return "null" if v is None else str(v)


def rows(names: list[str], values) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(_value(r[i]) for i in order) for r in values)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs between a DataFrame and a query; empty if nothing."""
    got, want = rows(df.columns, df.collect()), None
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows(names, rel.fetchall())
    if got == want:
        return ""
    a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"{len(got)} and {len(want)} rows; only here {len(a)} {a[:3]}, only there {len(b)} {b[:3]}"
