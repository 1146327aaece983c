"""Runs a registered query on Spark and its SQL twin on DuckDB, and compares.

    python -m tests.oracle [-s SF_DIR] [pattern ...]
"""

from __future__ import annotations

import datetime
import decimal
import fnmatch
import math
import sys
import time

import duckdb

from corpuskit.catalog.inputs import BASE_TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, key, fn, sql, sf_dir):
    """(ok, message) for one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got[1])} rows {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    note = f"{len(got[1])} rows spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        only = [r for r in got[1] if r not in want[1]][:2] if len(got[1]) < 20000 else got[1][:1]
        miss = [r for r in want[1] if r not in got[1]][:2] if len(want[1]) < 20000 else want[1][:1]
        return False, f"{len(got[1])} vs {len(want[1])} rows\n   spark only {str(only)[:700]}\n   sql only   {str(miss)[:700]}"
    if not got[1]:
        return True, note + " (EMPTY)"
    return True, note


def make_session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("corpuskit-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["-s"]:
        sf_dir, argv = argv[1], argv[2:]
    from corpuskit.catalog import all_queries, all_sql

    spark, con, sqls = make_session(), duck(sf_dir), all_sql()
    bad, t0 = [], time.time()
    for key, fn in all_queries().items():
        if argv and not any(fnmatch.fnmatch(key, p) for p in argv):
            continue
        try:
            ok, message = compare(spark, con, key, fn, sqls.get(key), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(("ok   " if ok else "FAIL ") + key, message, flush=True)
        if not ok:
            bad.append(key)
    print(f"{len(bad)} failed: {bad} in {time.time() - t0:.0f}s")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
