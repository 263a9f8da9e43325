"""Run named queries against their SQL twins: ``python tests/compare.py <folder> [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def spark_rows(frame):
    return rows_of(frame.columns, [tuple(row) for row in frame.collect()])


def twin_rows(connection, sql):
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    return rows_of(columns, cursor.fetchall())


def first_difference(left, right):
    for a, b in zip(left, right):
        if a != b:
            return [(x, y) for x, y in zip(a, b) if x != y][:3], a[:2]
    return None


def main():
    from newsloom.catalog import QUERIES, TWINS
    from newsloom.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            columns, rows = spark_rows(frame)
        except Exception as problem:
            bad += 1
            print(f"FAIL {name}: spark {str(problem)[:1500]}")
            continue
        spent = time.time() - start
        if name not in TWINS:
            print(f"rows {name}: {len(rows)} ({spent:.1f}s)")
            continue
        start = time.time()
        try:
            twin_columns, twin = twin_rows(connection, TWINS[name])
        except Exception as problem:
            bad += 1
            print(f"FAIL {name}: sql {str(problem)[:1500]}")
            continue
        twin_spent = time.time() - start
        if columns != twin_columns or rows != twin:
            bad += 1
            print(f"FAIL {name}: {len(rows)} rows against {len(twin)}; {columns} / {twin_columns}")
            print("    ", str(first_difference(rows, twin))[:1500])
            continue
        print(f"ok   {name}: {len(rows)} rows (spark {spent:.1f}s, sql {twin_spent:.1f}s)", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
