"""Run every query beside its SQL in DuckDB: python tests/oracle_check.py [folder] [name ...]"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, float) and math.isfinite(value):
        return round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, con, query, sql, folder):
    """None when equal, else a description."""
    df = query(spark, folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} / {names}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    expect = {
        "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE",
        "array<string>": "VARCHAR[]", "timestamp": "TIMESTAMP WITH TIME ZONE",
    }
    wrong = {
        d[0]: (kinds[d[0]], str(d[1])) for d in result.description if expect.get(kinds[d[0]]) != str(d[1])
    }
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    if ours != theirs:
        extra, missing = (list(d.items())[:3] for d in (ours - theirs, theirs - ours))
        return f"rows {sum(ours.values())}/{sum(theirs.values())}: {extra} <> {missing}"
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), e.oracle_sql()
    for name, query in e.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        if name in sqls:
            try:
                outcome = difference(spark, con, query, sqls[name], folder) or "equal"
            except Exception as error:
                outcome = f"ERROR {str(error)[:700]}"
        else:
            outcome = f"no SQL, {query(spark, folder).count()} rows"
        print(f"{name:32} {time.time() - start:6.2f}s {outcome}", flush=True)
