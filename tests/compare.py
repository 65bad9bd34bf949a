"""Run registered queries on Spark and DuckDB and compare the rows.

python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
         "BOOLEAN": "boolean", "FLOAT": "float"}


def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _row(values):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in values)


def differences(df, connection, sql) -> list[str]:
    """What differs between the Spark result and that of the SQL, if anything."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    expected = connection.execute(sql).fetchall()
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for column, kind in df.dtypes:
        if KINDS.get(kinds[column], kinds[column]) != kind:
            found.append(f"type of {column}: {kind} against {kinds[column]}")
    columns = sorted(names)
    got = sorted((_row(r[c] for c in columns) for r in df.collect()), key=repr)
    at = [names.index(c) for c in columns]
    want = sorted((_row(r[i] for i in at) for r in expected), key=repr)
    if len(got) != len(want):
        found.append(f"{len(got)} rows against {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}"[:700])
    return found


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__

    runs, sqls = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(runs)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = duck(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            df, sql = runs[name](spark, sf_dir), sqls.get(name)
            problems = differences(df, connection, sql) if sql else ([] if df.count() else ["no rows"])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
