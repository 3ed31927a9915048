"""Run a registered query in Spark and its SQL in DuckDB, and compare rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "FLOAT": "float",
}


def compare(spark, con, name, query, sql, sf_dir):
    """Return a list of problems (empty when equal), the row count and seconds."""
    started = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return [], len(rows), seconds
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {n: str(t) for n, t in zip(names, [d[1] for d in result.description])}
    expected = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"], len(rows), seconds
    for column, kind in df.dtypes:
        if KINDS.get(types[column], types[column]) != kind:
            problems.append(f"type of {column}: {kind} != {types[column]}")
    ours, theirs = normal_rows(df.columns, rows), normal_rows(names, expected)
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows != {len(theirs)}")
    if ours != theirs:
        a, b = set(ours), set(theirs)
        problems.append(
            f"{len(a - b)} rows differ, e.g. {sorted(a - b)[:2]} vs {sorted(b - a)[:2]}"
        )
    return problems, len(rows), seconds


def main(argv):
    from conftest import make_session

    import __spark_entry__ as contract

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), open_tables(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in argv or sorted(queries):
        try:
            problems, rows, seconds = compare(
                spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            problems, rows, seconds = [f"{type(error).__name__}: {str(error)[:600]}"], -1, 0.0
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracles else "rows")
        print(f"{mark:5}{name:32}{rows:>8} rows {seconds:6.2f}s", *problems, sep="\n      "
              if problems else " ", flush=True)
    print(f"{bad} of {len(argv or queries)} failed")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
