"""Vectors kept by what they were made of: a table in a folder of its own, found again only if it is whole."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "complete.json"


def ids_digest(rows: DataFrame, id_col: str = "id") -> tuple[int, str]:
    """The number of ids and a digest of them, whatever their order: two sums of hashes over all rows."""
    name = F.col(id_col).cast("string")
    one, two = (F.xxhash64(name, F.lit(k)).cast("decimal(38,0)") for k in (1, 2))
    n, a, b = rows.agg(F.count("*"), F.sum(one), F.sum(two)).first()
    return n, hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()


def facts(rows: DataFrame, corpus: str, encoder: str, stamp: str, id_col: str = "id") -> dict:
    """What a table of vectors is made of: corpus, encoder, the stamp of its checkpoint, and the ids."""
    n, digest = ids_digest(rows, id_col)
    return {"corpus": corpus, "encoder": encoder, "stamp": stamp, "n": n, "ids": digest}


def _folder(spark: SparkSession, root: str, made_of: dict):
    key = hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{made_of['corpus']}-{key[:32]}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def found(spark: SparkSession, root: str, made_of: dict) -> DataFrame | None:
    """The vectors made of just this; None where there are none, the marker is missing or says something else, or the
    table can't be read or has another number of rows."""
    path, files = _folder(spark, root, made_of)
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, MARKER)
    if not files.exists(marker):
        return None
    try:
        said = json.loads("".join(r[0] for r in spark.read.text(marker.toString(), wholetext=True).collect()))  # one small file
        if {k: said.get(k) for k in made_of} != made_of:
            return None
        vectors = spark.read.parquet(f"{path.toString()}/{said['table']}")
        return vectors if vectors.count() == made_of["n"] and vectors.where("embedding is null").isEmpty() else None
    except (PySparkException, ValueError, KeyError):
        return None


def cached_vectors(rows: DataFrame, root: str, corpus: str, encoder: str, stamp: str, encode: Callable[[DataFrame], DataFrame], id_col: str = "id") -> tuple[DataFrame, bool]:
    """(vectors (<id>, embedding), whether they were there): ``encode(rows)``, or what it gave before for the same ids.

    A table is written under a new name, and the marker that names it after it; so a write that stopped half-way, or two
    at once, leave no table that counts.
    """
    spark = rows.sparkSession
    made_of = facts(rows, corpus, encoder, stamp, id_col)
    there = found(spark, root, made_of)
    if there is not None:
        return there, True
    path, files = _folder(spark, root, made_of)
    table = f"vectors-{uuid.uuid4().hex}"
    encode(rows).select(id_col, "embedding").write.parquet(f"{path.toString()}/{table}")
    vectors = spark.read.parquet(f"{path.toString()}/{table}")
    if vectors.count() != made_of["n"]:
        raise ValueError(f"{made_of['n']} rows gave {vectors.count()} vectors")
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(path, MARKER), True)
    try:
        out.write(bytearray(json.dumps(made_of | {"table": table}).encode()))
    finally:
        out.close()
    return vectors, False
