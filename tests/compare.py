"""Compare registered queries with their SQL: ``python tests/compare.py [sf] [name ..]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[int, int, list, list]:
    """Row counts, and what only Spark or only the SQL has."""
    df = entry.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    a, b = set(ours), set(theirs)
    return len(ours), len(theirs), sorted(a - b), sorted(b - a)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    con = connect(sf_dir)
    for name in sys.argv[2:] or list(entry.oracle_sql()):
        began = time.time()
        try:
            n, m, more, less = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            print(f"{name}: ERROR {str(error)[:1500]}")
            continue
        print(f"{name}: {'ok' if n == m and not more and not less else 'DIFF'} {n} {m} {time.time() - began:.1f}s")
        if more or less:
            print("  only spark", len(more), [str(r)[:700] for r in more[:2]])
            print("  only sql", len(less), [str(r)[:700] for r in less[:2]])
