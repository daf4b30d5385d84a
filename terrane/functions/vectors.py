"""Array arithmetic on columns, and hash ranks that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    """The vector over its length, which counts as ``least`` at least."""
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x / n)


def unit_or_self(v: Column) -> Column:
    """The vector over its length as floats; a zero vector stays as it is."""
    n = norm(as_doubles(v))
    return F.transform(as_doubles(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n)).cast("array<float>")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def hash_rank(seed: int, *parts: Column) -> Column:
    """A text whose order is a permutation fixed by the seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def near(a: Column, b: Column, rel: float = 1e-9) -> Column:
    """Equality within a relative tolerance."""
    return F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b))
