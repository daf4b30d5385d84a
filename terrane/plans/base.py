"""How queries are registered, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

DIGITS = 6
QUERIES, SQL = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def rounded(df, *names):
    """``df`` with columns rounded, so that sums in another order give the same rows; minus zero becomes zero."""
    return df.select(*[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) if c in names else c for c in df.columns])
