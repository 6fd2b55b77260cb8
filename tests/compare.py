"""Run registered queries on both engines and compare the rows: python -m tests.compare [prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback
from concurrent.futures import ThreadPoolExecutor

import duckdb

import catalogue
from attestor.session import build_session
from attestor.sources.derived import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of_duckdb(con, entry) -> tuple[list[str], list[tuple]]:
    cur = con.execute(catalogue.duckdb_statement(entry))
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def rows_of_spark(spark, folder, entry) -> tuple[list[str], list[tuple]]:
    df = catalogue.spark_query(entry)(spark, folder)
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def check(spark, con, folder: str, key: str) -> bool:
    entry = catalogue.REGISTRY[key]
    began = time.time()
    try:
        names, got = rows_of_spark(spark, folder, entry)
        took = time.time() - began
        if entry.sql is None:
            print(f"{key}: rows only {len(got)} {took:.1f}s", flush=True)
            return True
        want_names, want = rows_of_duckdb(con.cursor(), entry)
    except Exception as error:
        print(f"{key}: ERROR {type(error).__name__} {str(error)[:700]}", flush=True)
        if os.environ.get("TRACE"):
            traceback.print_exc()
        return False
    if names != want_names:
        print(f"{key}: COLUMNS {sorted(set(names) ^ set(want_names))}", flush=True)
        return False
    if repr(got) != repr(want):
        pairs = [(a, b) for a, b in zip(got, want) if a != b][:2]
        print(f"{key}: DIFFERS {len(got)} vs {len(want)}\n   {names}\n   {pairs}", flush=True)
        return False
    print(f"{key}: ok {len(got)} {took:.1f}s{' EMPTY' if not got else ''}", flush=True)
    return True


def main(prefixes: list[str]) -> int:
    catalogue.load_all()
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    keys = [k for k in catalogue.REGISTRY if not prefixes or any(k.startswith(p) for p in prefixes)]
    with ThreadPoolExecutor(int(os.environ.get("THREADS", "4"))) as pool:
        good = list(pool.map(lambda key: check(spark, con, folder, key), keys))
    print("checked:", len(good), "bad:", good.count(False))
    return 1 if False in good else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
