"""Run registered queries next to their oracle text and compare the rows.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value + 0.0:.4f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    problems = []
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    same = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    odd = {c: (t, described.get(c)) for c, t in df.dtypes if same.get(described.get(c)) != t}
    if odd:
        problems.append(f"types {odd}")
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} / {sorted(names)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    if got != want:
        differing = [(a, b) for a, b in zip(got, want) if a != b]
        problems.append(f"{len(differing)} rows differ, first: {differing[:2]}")
    return len(got), problems


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or list(queries):
        began = time.time()
        try:
            if name in oracles:
                n, problems = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                n, problems = len(queries[name](spark, sf_dir).collect()), ["no oracle"]
        except Exception as error:  # noqa: BLE001
            n, problems = -1, [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems) and problems != ["no oracle"]
        print(f"{'OK ' if not problems else 'BAD'} {name} rows={n} {time.time() - began:.1f}s", *problems)
    missing = set(oracles) - set(queries)
    print(f"{len(queries)} queries, {len(oracles)} oracles, {bad} bad, oracle without query: {missing}")


if __name__ == "__main__":
    main()
