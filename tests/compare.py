"""Compare a registered query with its check SQL: columns, row count and rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _clean(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_clean(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"int": {"INTEGER", "BIGINT", "HUGEINT"}, "double": {"DOUBLE"}, "float": {"FLOAT"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}}
EXACT = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> list[str]:
    out = []
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    if set(mine) != set(theirs):
        return [f"columns {sorted(mine)} != {sorted(theirs)}"]
    for c, t in mine.items():
        if EXACT.get(t) != theirs[c]:
            out.append(f"type of {c}: {t} vs {theirs[c]}")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b = rows_of(names, cur.fetchall())
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"only here {sorted(sa - sb, key=repr)[:3]} ({len(sa - sb)}); only there {sorted(sb - sa, key=repr)[:3]} ({len(sb - sa)})")
    return out
