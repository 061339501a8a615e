"""Compare each query with its SQL in DuckDB: row count, columns, values.

Usage: python tools/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def spark_session() -> SparkSession:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false") \
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC") \
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([plain(row[i]) for i in order] for row in rows)


def compare(df, con, sql) -> str:
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = table([c[0] for c in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}" if bad else ""


def main() -> None:
    from catalog import all_oracles, all_queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = spark_session(), duck(sf_dir)
    oracles, failed = all_oracles(), 0
    for name, query in all_queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(query(spark, sf_dir), con, oracles[name])
            else:
                problem = "" if len(query(spark, sf_dir).collect()) else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        note = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{note} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
