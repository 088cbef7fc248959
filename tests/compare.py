"""Runs a query and its SQL twin over one data folder and compares rows and types."""

from __future__ import annotations

import math
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def _plain(x: object) -> object:
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def assert_same(spark, f, sql: str, data: Path = DATA) -> int:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = f(spark, str(data))
    want = con.execute("DESCRIBE " + sql).fetchall()
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema} == {r[0]: r[1] for r in want}
    columns = sorted(df.columns)
    names = [r[0] for r in want]
    rows = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in con.execute(sql).fetchall())
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    assert got == rows
    return len(got)
