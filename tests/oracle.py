"""Compares each query with its SQL on one of the driver's folders: python tests/oracle.py DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            db.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


#: Spark's names of types that SQL's may differ from only in spelling.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(spark, query, sql, folder, db) -> str:
    """Empty if the results agree."""
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    rel = db.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if t in TYPES and kinds[c] != TYPES[t] and kinds[c] in TYPES.values()}
    if odd:
        return f"types {odd}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:1]
        return f"{len(got)} and {len(want)} rows; {str(odd)[:600]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(os.environ.get("ORACLE_MASTER", "local[8]")).config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    folder, queries, sql = sys.argv[1], entry.queries(), entry.oracle_sql()
    db, bad = connect(folder), 0
    for name in sys.argv[2:] or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            said = compare(spark, queries[name], sql[name], folder, db) if name in sql else f"(no SQL) {queries[name](spark, folder).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__} {str(e)[:700]}"
        bad += bool(said) and name in sql
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
    print("disagree:", bad)
