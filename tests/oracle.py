"""Run every check query next to its SQL in DuckDB and compare rows and types."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return "null" if value is None else str(value)


def rows_of(arrow) -> tuple[list[str], list[tuple]]:
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    return names, sorted(tuple(cell(v) for v in row) for row in zip(*columns))


def kinds(arrow) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "").split("[")[0] for f in arrow.schema}


def compare(spark, con, query, sql: str, folder: str) -> str:
    """'' when both engines agree, else what differs."""
    left, right = query(spark, folder).toArrow(), con.execute(sql).to_arrow_table()
    (names_l, rows_l), (names_r, rows_r) = rows_of(left), rows_of(right)
    if names_l != names_r:
        return f"columns {names_l} / {names_r}"
    if kinds(left) != kinds(right):
        a, b = kinds(left), kinds(right)
        return f"types { {n: (a[n], b[n]) for n in a if a[n] != b[n]} }"
    if len(rows_l) != len(rows_r):
        return f"{len(rows_l)} rows / {len(rows_r)} rows"
    bad = [(a, b) for a, b in zip(rows_l, rows_r) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ("no rows" if not rows_l else "")


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(folder), e.oracle_sql()
    for name, query in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.perf_counter()
        try:
            if name in sqls:
                out = compare(spark, con, query, sqls[name], folder) or "ok"
            else:
                out = f"rows only: {query(spark, folder).count()}"
        except Exception as error:
            out = "ERROR " + str(error)[:1500]
        print(f"{name}: {out} [{time.perf_counter() - started:.1f}s]", flush=True)


if __name__ == "__main__":
    main()
