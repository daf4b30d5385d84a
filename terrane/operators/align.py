"""Joins that fail unless every key is on both sides once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Misaligned(ValueError):
    """Two tables whose keys aren't the same, once each."""


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, failing the query at a key that is missing on a side, doubled or null.

    The check is a filter over a full join: rows of a key meet anyway, so it adds a count per key and no shuffle.
    """
    one, two = left.withColumn("left_", F.lit(1)), right.withColumn("right_", F.lit(1))
    both = one.join(two, key, "full_outer").withColumn("times_", F.count("*").over(W.partitionBy(key)))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    wrong = (
        F.when(F.col(key).isNull(), "a null key")
        .when(F.col("left_").isNull(), F.concat(F.lit("only on the right: "), name))
        .when(F.col("right_").isNull(), F.concat(F.lit("only on the left: "), name))
        .when(F.col("times_") > 1, F.concat(F.lit("more than once: "), name))
    )
    fit = both.where(F.when(wrong.isNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"misaligned {key}: "), wrong)).cast("boolean")))
    return fit.drop("left_", "right_", "times_")


def counted(left: DataFrame, right: DataFrame, key: str) -> dict[str, int]:
    """How many keys are on the left, on the right, on both sides, and doubled or null."""
    keys = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    both = keys(left, "l").join(keys(right, "r"), key, "full_outer")
    row = both.agg(F.count("l").alias("left"), F.count("r").alias("right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if((F.col("l") > 1) | (F.col("r") > 1) | F.col(key).isNull()).alias("doubled")).first()
    return row.asDict()


def checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``aligned``, after a look at the counts of keys: the error says how many are wrong."""
    n = counted(left, right, key)
    if n["doubled"] or not n["left"] == n["right"] == n["matched"]:
        raise Misaligned(f"{key}: {n['left']} on the left, {n['right']} on the right, {n['matched']} on both, {n['doubled']} doubled or null")
    return left.join(right, key)
