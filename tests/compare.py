"""Run registered queries next to their oracle SQL and compare all rows.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return "no rows"
    different = [(a, b) for a, b in zip(got, want) if a != b]
    if different:
        return f"{len(different)} of {len(got)} rows differ, e.g. {sorted(df.columns)}\n  {different[0][0]}\n  {different[0][1]}"
    return None


def main() -> None:
    import __spark_entry__ as registered
    from rewardmill.session import local_session

    sf_dir = sys.argv[1]
    queries, oracles = registered.queries(), registered.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}", flush=True)
        if problem:
            failed.append(name)
            print(problem, flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} equal; failed: {failed}")


if __name__ == "__main__":
    main()
