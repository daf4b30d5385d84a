"""Run registered queries next to their SQL in DuckDB and compare rows as multisets.  Usage: python tests/oracle.py DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = os.path.join(sf_dir, name)
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{source}')")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) > 1 << 53 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def compare(got, got_names, want, want_names):
    """What differs, or an empty string."""
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    a = sorted(tuple(norm(r[got_names.index(c)]) for c in sorted(got_names)) for r in got)
    b = sorted(tuple(norm(r[want_names.index(c)]) for c in sorted(got_names)) for r in want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, as {bad[0]}" if bad else ""


def check(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    rows = [tuple(r.asDict(recursive=True).values()) if len(set(df.columns)) == len(df.columns) else tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    return compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description]), len(rows)


def main(sf_dir, names):
    import __spark_entry__ as entry

    spark, con = session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            if name in oracles:
                said, n = check(spark, con, queries[name], oracles[name], sf_dir)
            else:
                said, n = "", queries[name](spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            said, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(said)
        print(f"{'BAD' if said else 'ok '} {name} {'sql' if name in oracles else 'rows'} {n} {time.time() - began:.1f}s {said}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
