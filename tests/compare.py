"""Row-by-row comparison of a Spark result with DuckDB's, columns by name, rows in any order."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v else "0"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows])


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    theirs = rows_of(names, rel.fetchall())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    if len(mine) != len(theirs):
        out.append(f"rows {len(mine)} vs {len(theirs)}")
    if not out and mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        out.append(f"{len(a)} rows differ; spark {sorted(a)[:limit]} duckdb {sorted(b)[:limit]}")
    return out
