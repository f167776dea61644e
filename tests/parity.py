"""Runs registered queries next to their SQL on DuckDB and compares whole results."""

from __future__ import annotations

import math
import pathlib
import sys
import time
from decimal import Decimal

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and (math.isnan(v) or math.isinf(v)):
            return f"bad:{v}"
        return f"{float(v):.9g}"
    return str(v)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """Empty text when both results agree."""
    df = query(spark, sf_dir)
    got_cols = df.columns
    got = df.collect()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    order = sorted(got_cols)
    gi, wi = [got_cols.index(c) for c in order], [want_cols.index(c) for c in order]
    a = sorted(tuple(_cell(r[i]) for i in gi) for r in got)
    b = sorted(tuple(_cell(r[i]) for i in wi) for r in want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if any("bad:" in c for r in a for c in r):
        return "non-finite value"
    if bad:
        return f"{len(bad)} rows differ, first: {dict(zip(order, bad[0][0]))} vs {dict(zip(order, bad[0][1]))}"
    return "" if a else "EMPTY RESULT"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, name, query, sqls[name], sf_dir)
            else:
                verdict = "" if query(spark, sf_dir).count() else "EMPTY RESULT"
        except Exception as exc:  # report and go on
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(verdict)
        print(f"{'ok  ' if not verdict else 'FAIL'} {name} {time.time() - t:.2f}s {verdict}", flush=True)
    print("failed:", failed)
