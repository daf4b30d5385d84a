"""The result table as a stream: micro-batches of rows are merged by key, in buckets of the key's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrane.operators.results import IDENTITY, canonical, upsert
from terrane.sources.tables import drop_path

#: Buckets of a table unless told otherwise: take one for some 100 MB of it, and never change their number later.
BUCKETS = 64


def _versions(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """The batch that last wrote each bucket (a row each)."""
    if number < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{target}/manifest/{number}").collect()}


def _read(spark: SparkSession, target: str, versions: dict[int, int], schema) -> DataFrame | None:
    paths = [f"{target}/data/v{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def merge_batches(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: tuple[str, ...] = IDENTITY, order: str = "event_id", files: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Reads JSON lines as they arrive in ``source`` and keeps the last row of every key, with its first place ``pos``.

    Keys are dealt to ``buckets`` by hash.  A batch rewrites only the buckets that it touches, under a number of its own, and then the list of the buckets'
    versions; a batch that is repeated after a failure writes the same files again.  Versions that the last list
    doesn't name any more are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty() and number:
            versions = _versions(spark, target, number - 1)
        else:
            bucket = F.pmod(F.xxhash64(*[canonical(F.col(k)) for k in key]), F.lit(buckets)).cast("int")
            new = batch.withColumn("pos", F.col(order)).withColumn("bucket", bucket)
            touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
            before = _versions(spark, target, number - 1)
            old = _read(spark, target, {b: v for b, v in before.items() if b in touched}, new.drop("bucket").schema)
            rows = new.drop("bucket") if old is None else old.unionByName(new.drop("bucket"))
            upsert(rows, key, order).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/v{number}")
            versions = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(versions.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/{number}")
        if number > 1:
            for v in set(_versions(spark, target, number - 2).values()) - set(versions.values()) - set(_versions(spark, target, number - 1).values()):
                drop_path(spark, f"{target}/data/v{v}")
            if number > 2:
                drop_path(spark, f"{target}/manifest/{number - 3}")

    stream = spark.readStream.schema(schema)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    return stream.json(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, schema: str, number: int) -> DataFrame:
    """The table after batch ``number``."""
    return _read(spark, target, _versions(spark, target, number), f"{schema}, pos bigint")
