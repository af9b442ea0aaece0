"""Rows of a Spark result against rows of DuckDB SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):  # noqa: ANN001, ANN201
    """A value in a form that both engines give alike."""
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def rows_of(df) -> Counter:  # noqa: ANN001
    names = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def oracle(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
