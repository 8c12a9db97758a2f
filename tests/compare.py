"""Run registered queries against their SQL in DuckDB and report differences."""

from __future__ import annotations

import os
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, float):
        return round(value, 9)
    return str(value)


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_key(t[i]) for i in order) for t in tuples), key=repr)


def check(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return took, len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return took, len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in got]), rows(names, want)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return took, len(got), f"{len(a)} vs {len(b)} rows; spark only {sorted(sa - sb)[:2]}; sql only {sorted(sb - sa)[:2]}"
    return took, len(got), None


def main(sf_dir: str, only: list[str]) -> int:
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from revtrack.session import BUILDER_CONF

    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    for k, v in BUILDER_CONF.items():
        builder = builder.config(k, v)
    spark = builder.config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            took, n, diff = check(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            took, n, diff = 0.0, -1, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name:36s} {took:6.2f}s {n:8d} {diff or ''}", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1], sys.argv[2:]))
