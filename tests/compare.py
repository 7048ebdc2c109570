"""Order-insensitive comparison of a query with its SQL twin."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def database(sf: str = SF):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    s = str(v)
    return s[:10] if len(s) == 19 and s.endswith(" 00:00:00") else s


def rows(frame, columns):
    return sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None))


def same(spark_frame, sql: str, sf: str = SF) -> None:
    want, got = database(sf).execute(sql).df(), spark_frame.toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(want, columns) == rows(got, columns)
