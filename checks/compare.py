"""Run registered queries next to their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from adtally.session import local_session
from checks import oracles, queries as lazy, stored


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def queries() -> dict[str, lazy.Query]:
    return lazy.queries() | stored.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | stored.oracle_sql()


def database(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(root).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def difference(spark: SparkSession, connection: duckdb.DuckDBPyConnection, root: str, name: str) -> str | None:
    """None if both sides give the same rows, else the first thing that differs."""
    df = queries()[name](spark, root)
    ours = _rows(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(oracle_sql()[name])
    names = [column[0] for column in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    if not ours:
        return "no rows"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows instead of {len(theirs)}"
    for mine, other in zip(ours, theirs):
        if mine != other:
            cells = [
                f"{column}: {a!r} instead of {b!r}"
                for column, a, b in zip(sorted(names), mine, other)
                if a != b or type(a) is not type(b)
            ]
            return "; ".join(cells)[:600]
    return None


def main() -> int:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, connection = local_session(8), database(root)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, connection, root, name)
        except Exception as error:  # report every query, whatever the others do
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        failed += problem is not None
        spent = time.time() - start
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {spent:.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
