"""Cosine geometry of labelled vectors, from sums and without pairs wherever sums are enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.vectors import as_doubles, unit


def components_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, pos, x): the components of the unit vectors."""
    return vectors.select("vec_id", "label", F.posexplode(unit(as_doubles(F.col("embedding")))).alias("pos", "x"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, pos, x): means of unit vectors."""
    return components_of(vectors).groupBy("label", "pos").agg(F.avg("x").alias("x"))


def centroid_separation(vectors: DataFrame) -> DataFrame:
    """One row: the mean cosine of two different centroids, NULL for fewer than two."""
    c = centroids(vectors)
    size = c.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    one = c.join(size, "label").groupBy("pos").agg(F.sum(F.col("x") / F.col("size")).alias("s"))
    labels = size.agg(F.count("*").alias("k"))
    return one.agg(F.sum(F.col("s") * F.col("s")).alias("ss")).crossJoin(labels).select(F.when(F.col("k") > 1, (F.col("ss") - F.col("k")) / (F.col("k") * (F.col("k") - 1))).alias("separation"), F.col("k").alias("labels"))


def within_between(vectors: DataFrame) -> DataFrame:
    """One row: mean cosine within classes (classes weigh the same), between classes, and the gap.

    The sum of all pairs' cosines is the squared length of the vectors' sum less their number, so one aggregation
    by class and component is all it takes.
    """
    by_class = components_of(vectors).groupBy("label", "pos").agg(F.sum("x").alias("s"))
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    own = by_class.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss")).join(sizes, "label")
    inside = own.agg(F.avg(F.when(F.col("n") > 1, (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))).alias("within"), F.sum("ss").alias("own_ss"), F.sum(F.col("n") * F.col("n")).alias("own_nn"), F.sum("n").alias("n"))
    every = by_class.groupBy("pos").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    between = (F.col("ss") - F.col("own_ss")) / (F.col("n") * F.col("n") - F.col("own_nn"))
    return inside.crossJoin(every).select("within", between.alias("between"), (F.col("within") - between).alias("gap"))


def class_cohesion(vectors: DataFrame) -> DataFrame:
    """(label, n, within): mean cosine of two vectors of a class."""
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    sums = components_of(vectors).groupBy("label", "pos").agg(F.sum("x").alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return sums.join(sizes, "label").select("label", "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("within"))
