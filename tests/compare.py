"""Run registered queries on Spark and their SQL on DuckDB and compare all rows.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) and not math.isnan(value) and value == 0:
        return 0.0
    return float(value) if isinstance(value, int) else value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "int", "DOUBLE": "float",
         "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "bool"}
SPARK_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "float", "float": "float",
               "string": "string", "boolean": "bool"}


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both sides hold the same columns and rows, else what differs."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs_by_name = {d[0]: str(d[1]) for d in expected.description}
    want = rows_of(names, expected.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first {got[:2]} against {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {sorted(names)}, first: {bad[0]}"
    mine = {n: SPARK_KINDS.get(t, t) for n, t in df.dtypes}
    theirs = {n: KINDS.get(t, t) for n, t in theirs_by_name.items()}
    odd = [n for n in mine if mine[n] != theirs[n]]
    return f"types differ: {[(n, mine[n], theirs[n]) for n in odd]}" if odd else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from voxloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(folder), oracle_sql(), []
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        begun = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                found = difference(df, con, sqls[name])
            else:
                found = None if df.collect() else "no rows"
        except Exception as failure:  # noqa: BLE001
            found = f"{type(failure).__name__}: {str(failure)[:1500]}"
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - begun:.1f}s {found or ''}", flush=True)
        if found:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
