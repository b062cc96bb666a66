"""Compares queries with their SQL in DuckDB: `python tests/oracle.py sf_dir [name ...]`."""

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted(columns), sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None, or what differs."""
    got = con.execute(sql)
    want = normal(got.fetchall(), [d[0] for d in got.description])
    have = normal([tuple(r) for r in df.collect()], df.columns)
    if want[0] != have[0]:
        return f"columns {have[0]}, SQL has {want[0]}"
    if len(want[1]) != len(have[1]):
        return f"{len(have[1])} rows, SQL has {len(want[1])}"
    return next((f"{a} where SQL has {b}" for a, b in zip(have[1], want[1], strict=True) if a != b), None)


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sys.argv[1]), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if n in sql]:
        began = time.time()
        try:
            print(name, compare(queries[name](spark, sys.argv[1]), con, sql[name]) or "same", f"{time.time() - began:.1f} s", flush=True)
        except Exception as e:
            print(name, "ERROR", str(e)[:600], flush=True)
