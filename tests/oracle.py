"""Compare registered queries with their SQL on the same Parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return ("decimal", str(x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, dt.datetime) and x.tzinfo:
        return x.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(x, (list, dict)):
        return repr(x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides agree exactly, types of the values included."""
    cols_s, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    cols_d, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols_s != cols_d:
        return [f"columns {cols_s} != {cols_d}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    bad = []
    for a, b in zip(got, want):
        for c, x, y in zip(cols_s, a, b):
            if x != y or type(x) is not type(y):
                bad.append(f"{c}: spark {x!r} oracle {y!r} in {a}")
                break
    return bad
