"""Agreement of partitions, jackknife errors and rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.stats import correlation_p
from terrane.operators.ranks import running


def contingency(parts: DataFrame) -> DataFrame:
    """(seed_a, seed_b, a, b, n) over points that both partitions (seed, vec_id, node) cover."""
    left, right = parts.select(F.col("seed").alias("seed_a"), "vec_id", F.col("node").alias("a")), parts.select(F.col("seed").alias("seed_b"), "vec_id", F.col("node").alias("b"))
    return left.join(right, "vec_id").where("seed_a < seed_b").groupBy("seed_a", "seed_b", "a", "b").agg(F.count("*").alias("n"))


def ari_nmi(parts: DataFrame) -> DataFrame:
    """(seed_a, seed_b, ari, nmi): adjusted Rand index (1 where undefined) and arithmetically normalised mutual information."""
    cells, key = contingency(parts), ["seed_a", "seed_b"]
    pairs = lambda c: c * (c - 1) / 2.0
    whole = cells.groupBy(*key).agg(F.sum("n").cast("double").alias("t"), F.sum(pairs(F.col("n"))).alias("ij"), F.sum(F.col("n") * F.log("n")).alias("h"))
    side = lambda c: cells.groupBy(*key, c).agg(F.sum("n").alias("m")).groupBy(*key).agg(F.sum(pairs(F.col("m"))).alias(f"p_{c}"), F.sum(F.col("m") * F.log("m")).alias(f"h_{c}"))
    r = whole.join(side("a"), key).join(side("b"), key).where("t > 1")
    t = F.col("t")
    expected, most = F.col("p_a") * F.col("p_b") / pairs(t), (F.col("p_a") + F.col("p_b")) / 2
    ha, hb, hab = (F.log(t) - F.col(c) / t for c in ("h_a", "h_b", "h"))
    ari = F.when(F.abs(most - expected) < 1e-12, 1.0).otherwise((F.col("ij") - expected) / (most - expected))
    return r.select(*key, ari.alias("ari"), F.when(ha + hb <= 1e-12, 1.0).otherwise((ha + hb - hab) / ((ha + hb) / 2)).alias("nmi"))


def jackknife(values: DataFrame) -> DataFrame:
    """One row (seeds, se): leave-one-seed-out error of the mean of (seed_a, seed_b, value); NULL under three seeds."""
    ends = values.select(F.explode(F.array("seed_a", "seed_b")).alias("seed"), "value")
    whole = values.agg(F.sum("value").alias("sum"), F.count("*").alias("n"))
    each = ends.groupBy("seed").agg(F.sum("value").alias("s"), F.count("*").alias("k")).crossJoin(F.broadcast(whole))
    means = each.where("n > k").select(((F.col("sum") - F.col("s")) / (F.col("n") - F.col("k"))).alias("m"))
    return means.agg(F.count("*").alias("seeds"), F.when(F.count("*") >= 3, F.sqrt((F.count("*") - 1) * F.var_pop("m"))).alias("se"))


def average_ranks(rows: DataFrame, group: list[str], c: str, bounded: bool = False) -> DataFrame:
    """(group, c, r_c): the average rank of every distinct value; only distinct values are ordered.

    bounded: a group's distinct values are known to be few; else they are ranked in ranges.
    """
    counts = rows.groupBy(*group, c).agg(F.count("*").alias("times_"))
    if bounded:
        counts = counts.withColumn("below_", F.coalesce(F.sum("times_").over(W.partitionBy(*group).orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    else:
        counts = running(counts, group, [c], "below_", F.col("times_"))
    return counts.select(*group, c, (F.col("below_") + (F.col("times_") + 1) / 2).alias(f"r_{c}"))


def spearman(rows: DataFrame, group: list[str], x: str, y: str, bounded: bool = False) -> DataFrame:
    """(group, n, rho): correlation of average ranks; NULL for constant columns.  Rows with a NULL are left out."""
    rows = rows.select(*group, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = rows.join(average_ranks(rows, group, x, bounded), [*group, x]).join(average_ranks(rows, group, y, bounded), [*group, y])
    x, y = f"r_{x}", f"r_{y}"
    spread = F.stddev_pop(x) * F.stddev_pop(y)  # corr() itself divides by zero for a constant column
    return both.groupBy(*group).agg(F.count("*").alias("n"), F.when(spread > 0, F.covar_pop(x, y) / spread).alias("rho"))


def bootstrap(stats: DataFrame, names: list[str]) -> DataFrame:
    """One row: mean_<stat> and cv_<stat> over the seeds (0 where the mean is 0), and the number of seeds."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    cv = lambda c: F.when(mean(c) == 0, 0.0).otherwise(F.coalesce(F.stddev_samp(c), F.lit(0.0)) / mean(c))
    return stats.agg(*[mean(c).alias(f"mean_{c}") for c in names], *[cv(c).alias(f"cv_{c}") for c in names], F.count("*").alias("n_successful_seeds"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """One row: mean and deviation of ari and nmi (0 where there are too few pairs), and the number of pairs."""
    return pairs.agg(F.count("*").alias("pairs"), *[F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in ("ari", "nmi") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def with_p(found: DataFrame, legacy: bool = False) -> DataFrame:
    """``found`` (n, rho, ...) with the two-sided p-value of each correlation; where there is none it is NULL, or 1 in the
    legacy form."""
    p = correlation_p(F.col("rho"), F.col("n"))
    return found.withColumn("p", F.coalesce(p, F.lit(1.0)) if legacy else p)
