"""Runs queries next to their SQL and compares rows, names and types.

``python tests/oracle.py [name ...]`` checks the named queries, or all of them.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPE_WORDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def compare(df, con, sql: str) -> str:
    """An empty string if both sides agree, else what differs."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    for field in df.schema.fields:
        expected = TYPE_WORDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if types[field.name] != expected:
            return f"type of {field.name}: {expected} != {types[field.name]}"
    gi = [df.columns.index(n) for n in order]
    wi = [names.index(n) for n in order]
    a = sorted(tuple(plain(r[i]) for i in gi) for r in got)
    b = sorted(tuple(plain(r[i]) for i in wi) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, e.g. {str(bad[0])[:600]}"
    return "" if a else "no rows"


def main() -> int:
    from commentlab.plans import ENTRIES
    from commentlab.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("oracle")
    con = connect(sf)
    names = sys.argv[1:] or list(ENTRIES)
    bad = 0
    for name in names:
        e = ENTRIES[name]
        start = time.time()
        try:
            if e.sql is None:
                rows = len(e.run(spark, sf).collect())
                result = "" if rows else "no rows"
            else:
                result = compare(e.run(spark, sf), con, e.sql)
        except Exception as ex:  # noqa: BLE001
            result = f"{type(ex).__name__}: {str(ex)[:900]}"
        bad += bool(result)
        kind = "sql " if e.sql else "rows"
        print(f"{'ok  ' if not result else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {result}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
