"""Runs a query and its SQL side by side and compares rows without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):  # noqa: ANN001, ANN201
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return v
    if isinstance(v, int) or (isinstance(v, float) and v.is_integer()):
        return int(v)
    if isinstance(v, decimal.Decimal | float):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of_spark(df) -> Counter:  # noqa: ANN001
    names = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def rows_of_sql(sql: str, folder: str = FOLDER) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in found.fetchall())
