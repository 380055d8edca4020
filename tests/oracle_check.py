"""Run registered queries beside their plain SQL and compare the full results.

Usage: ``python tests/oracle_check.py FOLDER [QUERY ...]``
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


def canonical(value):
    """One spelling per value, so that both engines' results compare as text."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, folder: str, build, sql: str) -> dict:
    start = time.time()
    df = build(spark, folder)
    got = df.collect()
    seconds = time.time() - start
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    result = {"rows": len(got), "want_rows": len(want), "seconds": round(seconds, 2)}
    if sorted(df.columns) != sorted(names):
        result["problem"] = f"columns {sorted(set(df.columns) ^ set(names))}"
        return result
    spark_types = dict(df.dtypes)
    odd = {c: (spark_types[c], types[c]) for c in names
           if TYPES.get(spark_types[c], "?") != types[c]}
    if odd:
        result["types"] = odd
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        result["problem"] = (f"{sorted(names)} spark only {sorted(left)[:3]} "
                             f"sql only {sorted(right)[:3]}")
    return result


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "date": "DATE", "boolean": "BOOLEAN"}


def main() -> int:
    import __spark_entry__ as entry
    from cohortspark.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", spark__master="local[8]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            r = compare(spark, con, folder, queries[name], sql[name])
        except Exception as e:  # noqa: BLE001 - report every query
            r = {"problem": f"{type(e).__name__}: {str(e)[:600]}"}
        bad += "problem" in r
        print(("BAD " if "problem" in r else "ok  ") + name, r, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
