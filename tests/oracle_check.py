"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py <folder> [names]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*columns)) if names else []


def _types(table) -> dict[str, str]:
    plain = {"large_string": "string", "string_view": "string", "timestamp[us, tz=UTC]": "timestamp[us]"}
    return {f.name: plain.get(str(f.type), str(f.type)) for f in table.schema}


def difference(spark_table, sql_table) -> str:
    """Empty text when both results are equal."""
    if sorted(spark_table.column_names) != sorted(sql_table.column_names):
        return f"columns {sorted(set(spark_table.column_names) ^ set(sql_table.column_names))}"
    left, right = _rows(spark_table), _rows(sql_table)
    if left != right:
        only_left, only_right = sorted(set(left) - set(right)), sorted(set(right) - set(left))
        return f"rows {len(left)} vs {len(right)}; {sorted(spark_table.column_names)}\n  spark {only_left[:2]}\n  sql   {only_right[:2]}"
    mixed = {n: (t, _types(sql_table)[n]) for n, t in _types(spark_table).items() if t != _types(sql_table)[n]}
    return f"types {mixed}" if mixed else ""


def main(sf_dir: str, names: list[str]) -> int:
    from rankloom.plans.catalog import QUERIES
    from rankloom.plans.sql import ORACLES
    from rankloom.session import build_session

    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "America/Los_Angeles").getOrCreate()
    else:
        spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            result = QUERIES[name](spark, sf_dir).toArrow()
            middle = time.time()
            if name not in ORACLES:
                print(f"{name:28s} rows-only {result.num_rows}", flush=True)
                continue
            problem = difference(result, con.sql(ORACLES[name]).to_arrow_table())
        except Exception as error:  # noqa: BLE001
            result, problem, middle = None, f"ERROR {str(error)[:900]}", time.time()
        bad += bool(problem)
        count = result.num_rows if result is not None else -1
        print(f"{name:28s} {count:7d} {middle - start:6.2f}s {time.time() - middle:6.2f}s {'ok' if not problem else 'BAD ' + problem}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
