"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def _norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, name: str, run, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf_dir).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}'")
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols, name
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(_norm(r[i]) for i in at) for r in result.fetchall()), name
