"""Compare a query with its DuckDB SQL on the driver's tables."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    return x


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, f, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = f(spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(sql)
    theirs = normal([d[0] for d in r.description], r.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = [x for x in mine[1] if x not in set(theirs[1])][:2], [x for x in theirs[1] if x not in set(mine[1])][:2]
        return f"{len(mine[1])} and {len(theirs[1])} rows; only here {a}, only there {b}"
    return None
