"""Do hops in the cluster graph grow with the distance of texts?  Rank correlations per seed, two samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.vectors import distance, hash_rank
from terrane.operators import agreement, graph
from terrane.operators.ranks import placed
from terrane.sources.tables import stored

#: Under these many covered points, or connected pairs, there is no correlation.
LEAST_DOCS, LEAST_PAIRS = 50, 100
#: Points that are paired, and pairs that are ranked, of a seed; these samples are the method's own.
MOST_DOCS, MOST_PAIRS = 500, 5000


def sampled(parts: DataFrame, most: int = MOST_DOCS) -> DataFrame:
    """(seed, vec_id, node, ord): up to ``most`` covered points of each seed, by a hash of seed and point."""
    rows = parts.select("seed", "vec_id", "node", hash_rank(11, F.col("seed"), F.col("vec_id")).alias("h"))
    return placed(rows, ["seed"], ["h", "vec_id"], "ord").where(F.col("ord") < most).select("seed", "vec_id", "node", "ord")


def connected_pairs(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, i, j, a, b, hops): pairs of sampled points in one component, i before j; ``MOST_DOCS`` squared at most."""
    hop = stored(graph.hops(docs.select("seed", "node").distinct(), edges))
    left = docs.select("seed", F.col("vec_id").alias("i"), F.col("ord").alias("a"), F.col("node").alias("src"))
    right = docs.select("seed", F.col("vec_id").alias("j"), F.col("ord").alias("b"), F.col("node").alias("dst"))
    return left.join(right, "seed").where("a < b").join(hop, ["seed", "src", "dst"]).select("seed", "i", "j", "a", "b", "hops")


def _ranked(taken: DataFrame, features: DataFrame) -> DataFrame:
    """(seed, n, rho) of hops against distances of the points' features (vec_id, z)."""
    side = lambda v, z: features.select(F.col("vec_id").alias(v), F.col("z").alias(z))
    rows = taken.join(side("i", "zi"), "i").join(side("j", "zj"), "j")
    far = stored(rows.select("seed", F.col("hops").cast("double").alias("hops"), F.round(distance(F.col("zi"), F.col("zj")), 9).alias("far")))
    return agreement.spearman(far, ["seed"], "hops", "far", bounded=True)


def rho(parts: DataFrame, edges: DataFrame, features: DataFrame, legacy: bool = False, most_docs: int = MOST_DOCS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(seed, rho, n_pairs_used), for every seed of ``parts`` (seed, vec_id, node).

    Uniform: a uniform sample of the connected pairs; NULL with fewer than LEAST_DOCS points, LEAST_PAIRS pairs, or where
    all hops or all distances are equal.  Legacy: the first connected pairs in the order of the points; 0 instead of
    NULL with too few points (and then no pairs count) or too few pairs.  Points without features count as not covered.
    """
    known = parts.join(features.select("vec_id").distinct(), "vec_id", "left_semi")
    docs = stored(sampled(known, most_docs))
    covered = known.groupBy("seed").agg(F.count("*").alias("covered"))
    pairs = stored(connected_pairs(docs, edges))
    order = [F.col("a"), F.col("b")] if legacy else [hash_rank(13, F.col("seed"), F.col("i"), F.col("j")), F.col("i"), F.col("j")]
    at = F.row_number().over(W.partitionBy("seed").orderBy(*order))  # at most MOST_DOCS squared rows of a seed
    taken = pairs.withColumn("at", at).where(F.col("at") <= most_pairs)
    found = covered.join(pairs.groupBy("seed").agg(F.count("*").alias("connected")), "seed", "left").join(_ranked(taken, features), "seed", "left")
    few = (F.col("covered") < LEAST_DOCS) | (F.coalesce("connected", F.lit(0)) < LEAST_PAIRS)
    used = F.when(F.col("covered") < LEAST_DOCS, 0).otherwise(F.least(F.coalesce("connected", F.lit(0)), F.lit(most_pairs)))
    return found.select("seed", F.when(few, F.lit(0.0 if legacy else None).cast("double")).otherwise(F.col("rho")).alias("rho"), used.cast("long").alias("n_pairs_used"))


def summary(rhos: DataFrame) -> DataFrame:
    """One row (mean, sd, n): over the seeds with a finite correlation; sd is NULL for fewer than two."""
    r = F.when(F.col("rho").isNotNull() & ~F.isnan("rho") & (F.abs("rho") < float("inf")), F.col("rho"))
    return rhos.agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.count(r).alias("n"))


def alignment(lens: DataFrame, features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(feature, axis, rho): of each feature (vec_id, <names>) with the lens's axes u, v and their length; 0 where a column is constant."""
    axes = F.stack(F.lit(3), F.lit("u"), F.col("u"), F.lit("v"), F.col("v"), F.lit("radial"), F.hypot("u", "v")).alias("axis", "at")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("f")
    rows = lens.join(features, "vec_id").select("u", "v", each).select("f.feature", F.round("f.x", 9).alias("x"), axes).withColumn("at", F.round("at", 9))
    return agreement.spearman(stored(rows), ["feature", "axis"], "x", "at").select("feature", "axis", F.coalesce("rho", F.lit(0.0)).alias("rho"))
