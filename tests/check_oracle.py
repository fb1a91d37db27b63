"""Compare registered queries with their SQL: python tests/check_oracle.py [folder] [name ...]"""

import math
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
SMALL = "/root/testdata/sf0.001"


def connect(folder):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    return str(value)


def normal(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False))


def differences(spark, db, folder, name):
    """Empty when the query and its SQL agree in columns and rows."""
    got_columns, got = normal(entry.queries()[name](spark, folder).toPandas())
    want_columns, want = normal(db.sql(entry.oracle_sql()[name]).df())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    return [f"{a} != {b}" for a, b in zip(got, want) if a != b][:5]


def session(cores=8):
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    for name in names:
        began = time.time()
        try:
            if name in entry.oracle_sql():
                bad = differences(spark, db, folder, name)
                result = "equal" if not bad else f"DIFFERENT {bad[:3]}"
            else:
                result = f"{entry.queries()[name](spark, folder).count()} rows"
        except Exception as error:
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - began:6.1f}s {result}", flush=True)
