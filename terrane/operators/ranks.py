"""Running sums and places in an order that no task has to see as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.sources.tables import stored


def running(df: DataFrame, group: list[str], order: list[str], name: str, size: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``size`` (1: a count) over the rows of the group that come before, in ascending order.

    Rows are dealt to ranges of (group, order), summed by range, and summed again inside a range, so that windows hold
    the ranges of a group (as many as there are partitions) and the rows of one range.  Rows that are equal in ``order``
    share a range; their places among each other are as they come.
    """
    part = f"{name}_part"
    dealt = df.withColumn(f"{name}_size", F.lit(1) if size is None else size)
    dealt = stored(dealt.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    before = W.unboundedPreceding, -1
    sums = dealt.groupBy(*group, part).agg(F.sum(f"{name}_size").alias("all_"))
    starts = sums.select(*group, part, F.coalesce(F.sum("all_").over(W.partitionBy(*group).orderBy(part).rowsBetween(*before)), F.lit(0)).alias(f"{name}_start"))
    inner = F.coalesce(F.sum(f"{name}_size").over(W.partitionBy(*group, part).orderBy(*order).rowsBetween(*before)), F.lit(0))
    keys = [*group, part]
    names = {k: f"{name}_key{i}" for i, k in enumerate(keys)}
    starts = starts.select(*[F.col(k).alias(v) for k, v in names.items()], f"{name}_start")
    on = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    # as many rows as partitions times groups that share one
    return dealt.withColumn(name, inner).join(starts, on).withColumn(name, (F.col(name) + F.col(f"{name}_start"))).select(*df.columns, name)


def placed(df: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place in its group, from 0."""
    return running(df, group, order, name)


def first(df: DataFrame, group: list[str], order: list[str], many: Column) -> DataFrame:
    """The first ``many`` rows of each group."""
    return placed(df, group, order, "first_place").where(F.col("first_place") < many).drop("first_place")
