"""Compare each named query with its expected SQL: columns, row count and values in any order."""

from __future__ import annotations

import datetime
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (int, datetime.date)):
        return value
    return float(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(v := canonical(r[i])).__name__, v) for i in order) for r in rows)


def difference(name, spark, con, sf_dir, queries, expected) -> str | None:
    df = queries[name](spark, sf_dir)
    got = df.collect()
    if name not in expected:
        return None
    cur = con.execute(expected[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        return f"rows {len(got)} != {len(want)}; extra {list((a - b).items())[:2]}; lacking {list((b - a).items())[:2]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, expected = oracle(sf_dir), e.queries(), e.oracle_sql()
    bad = 0
    for name in queries:
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            problem = difference(name, spark, con, sf_dir, queries, expected)
        except Exception as err:  # report and go on
            problem = f"{type(err).__name__}: {str(err)[:400]}"
        n = con.execute(f"SELECT count(*) FROM ({expected[name]})").fetchall()[0][0] if name in expected and not problem else "-"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
