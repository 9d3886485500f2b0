"""Runs registered queries against their SQL in DuckDB and compares the rows strictly.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value)
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[int, str]:
    """(row count, problem); the problem is empty when both sides agree."""
    df = fn(spark, sf_dir)
    cursor = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if sorted(kinds) != sorted(df.columns):
        return 0, f"columns {sorted(df.columns)} vs {sorted(kinds)}"
    wrong = [c for c, t in df.dtypes if TYPES.get(t) != kinds[c]]
    if wrong:
        return 0, f"types differ: {[(c, dict(df.dtypes)[c], kinds[c]) for c in wrong]}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == expected:
        return sum(got.values()), ""
    extra, missing = got - expected, expected - got
    return sum(got.values()), (
        f"{sum(got.values())} vs {sum(expected.values())} rows; columns {sorted(df.columns)}; "
        f"only Spark {sorted(extra, key=str)[:3]}; only SQL {sorted(missing, key=str)[:3]}"
    )


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, *wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                rows, problem = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                rows, problem = len(fn(spark, sf_dir).collect()), ""
        except Exception as error:
            rows, problem = 0, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        kind = "sql" if name in oracles else "rows"
        mark, seconds = "FAIL" if problem else "ok  ", time.time() - start
        print(f"{mark} {name} [{kind}] {rows} rows {seconds:.1f}s {problem}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
