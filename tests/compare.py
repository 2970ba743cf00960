"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
         "BOOLEAN": "boolean"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(spark, connection, folder: str, run, sql: str) -> str | None:
    """None when both give the same columns, types up to naming, and rows."""
    frame = run(spark, folder)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    if kinds != dict(frame.dtypes):
        return f"types {dict(frame.dtypes)} and {kinds}"
    mine = rows_of(frame.columns, frame.collect())
    theirs = rows_of(names, result.fetchall())
    if not mine:
        return "no rows"
    if mine == theirs:
        return None
    return (f"{sum(mine.values())} rows and {sum(theirs.values())} rows; only here "
            f"{list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}")


def main() -> None:
    from pyspark.sql import SparkSession
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(folder), entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = difference(spark, connection, folder, run, sql[name])
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s "
              f"{found or ''}", flush=True)


if __name__ == "__main__":
    main()
