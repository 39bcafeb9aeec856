"""Compare a registered Spark query with its DuckDB oracle.

Rows are compared as multisets after normalising values (columns sorted by
name, times to ISO text); doubles must be equal to the bit.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v   # exact: no rounding of doubles
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v else None
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in data]


_SIMPLE = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
           "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
           "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "binary": "BLOB"}


def duck_type_of(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return spark_type.upper().replace(",", ",")
    if spark_type.startswith("array<"):
        return duck_type_of(spark_type[6:-1]) + "[]"
    return _SIMPLE.get(spark_type, spark_type)


def type_mismatches(df, con, sql: str) -> list[str]:
    """Columns whose Spark type does not map to the DuckDB type."""
    rel = con.sql(sql)
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for f in df.schema.fields:
        want = duck_type_of(f.dataType.simpleString())
        got = duck.get(f.name)
        if got is not None and got != want:
            out.append(f"{f.name}: spark {f.dataType.simpleString()} vs duck {got}")
    return out


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    sc, sr = rows_of_spark(df)
    dc, dr = rows_of_duck(con, sql)
    if sc != dc:
        return f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return f"row counts differ: spark={len(sr)} duck={len(dr)}"
    key = lambda r: repr(r)
    sr.sort(key=key)
    dr.sort(key=key)
    for a, b in zip(sr, dr):
        if a != b:
            return f"first differing row: spark={a!r} duck={b!r}"
    return None
