"""Compare a registered query with its SQL run in-process by DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import time
from collections import Counter

import duckdb

from loamlake.queries.base import TABLES


SPENT: dict[str, float] = {}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def norm(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(map(norm, value))
    return value


# Spark type -> the DuckDB types it may meet.
KINDS = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
    "timestamp": {"TIMESTAMP"},
    "date": {"DATE"},
}


def compare(spark, con, folder: str, name: str, queries, oracle) -> str | None:
    """None when schema and rows agree, else what differs."""
    began = time.time()
    df = queries[name](spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    SPENT[name] = time.time() - began
    if name not in oracle:
        return None if got else "no rows"
    res = con.execute(oracle[name])
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    types = dict(zip(names, [str(d[1]) for d in res.description]))
    for c, kind in df.dtypes:
        wanted = KINDS.get(kind)
        if wanted and types[c] not in wanted:
            return f"type of {c}: {kind} vs {types[c]}"
        if wanted is None and not kind.startswith("decimal"):
            return f"type of {c}: {kind} vs {types[c]} is not compared"
    index = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in index) for r in res.fetchall())
    if got == want:
        return None if got else "both empty"
    return f"{sum(got.values())} rows vs {sum(want.values())}; only spark {list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}"
