"""Runs registered queries on Spark and their SQL on DuckDB and compares columns, types and rows.

    python tests/compare.py [sf_dir] [query ...]"""

from __future__ import annotations

import atexit
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), round(v, 6) if isinstance(v, float) and not math.isnan(v) else str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 2e-9 * max(1.0, abs(a))
    return a == b and type(a) is type(b)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    result = con.execute(sql)
    ours, theirs = dict(df.dtypes), {d[0]: str(d[1]) for d in result.description}
    want = sorted(theirs)
    if names != want:
        return f"columns {names} vs {want}"
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for n in names:
        if TYPES.get(ours[n]) != described[n]:
            return f"type of {n}: {ours[n]} vs {described[n]}"
    spark_rows = sorted([tuple(r[n] for n in names) for r in df.collect()], key=_key)
    columns = ", ".join('"' + n + '"' for n in names)
    duck_rows = sorted(con.execute(f"SELECT {columns} FROM ({sql})").fetchall(), key=_key)
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}: {spark_rows[:2]} {duck_rows[:2]}"
    for a, b in zip(spark_rows, duck_rows, strict=True):
        if not all(_same(x, y) for x, y in zip(a, b, strict=True)):
            return f"row {dict(zip(names, a))} vs {dict(zip(names, b))}"
    return None


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    # Intermediate tables of one test session; cleared when it ends.
    folder = tempfile.TemporaryDirectory(prefix="kinfold-tests-")
    atexit.register(folder.cleanup)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder.name}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = session(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args[1:] or queries:
        start = time.time()
        try:
            if name in sql:
                found = difference(spark, con, queries[name], sql[name], sf_dir)
            else:
                found = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # a report for every query, also for broken ones
            found = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "" if name in sql else " (rows only)"
        print(f"{'ok ' if found is None else 'BAD'} {name}{kind} {time.time() - start:.1f}s {found or ''}", flush=True)


if __name__ == "__main__":
    main()
