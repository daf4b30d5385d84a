"""Bootstraps over seeds of which some may fail: a seed's error is a row, and the others go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import agreement, cover, graph
from terrane.operators.results import disintegrated

#: Seeds that must succeed for a bootstrap to say something.
ENOUGH = 2


def outcomes(found: DataFrame, by_seed: DataFrame) -> DataFrame:
    """(seed, error) of every seed asked for; ``found`` (seed, node, vec_id, error) has a row with an error for each task
    that failed, and of them the first text counts."""
    errors = found.where("error is not null").groupBy("seed").agg(F.min("error").alias("error"))
    return by_seed.join(errors, "seed", "left").select("seed", "error")


def succeeded(found: DataFrame, by_seed: DataFrame) -> DataFrame:
    """(seed, node, vec_id) of the seeds without an error."""
    fine = F.broadcast(outcomes(found, by_seed).where("error is null").select("seed"))  # seeds are few
    return found.where("error is null").join(fine, "seed", "left_semi").select("seed", "node", "vec_id")


def per_seed(stats: DataFrame, by_seed: DataFrame, names: list[str]) -> DataFrame:
    """One row: ``seeds`` in order and a list for each name, with NULL where a seed has no value."""
    rows = by_seed.join(stats.select("seed", *names), "seed", "left")
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("seed", *names))).alias("r"))  # seeds are few
    return whole.select(F.col("r.seed").alias("seeds"), *[F.col(f"r.{n}").alias(n) for n in names])


def stability(found: DataFrame, by_seed: DataFrame, points: int) -> DataFrame:
    """One row: how much the seeds' covers agree, how many succeeded, which failed, and whether the graph fell apart.

    With fewer than ENOUGH successes there are no figures: ``error`` says so, and the graph counts as fallen apart.
    """
    told = outcomes(found, by_seed).agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("n_successful_seeds"), F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("seed", "error")))).alias("failed"),
    )
    n = succeeded(found, by_seed)
    pairs = agreement.pair_summary(agreement.ari_nmi(cover.partition(n)))
    stats = agreement.bootstrap(graph.statistics(n, cover.nerve(n), points), ["coverage", "n_nodes"]).select(F.col("mean_coverage").alias("coverage"), F.col("mean_n_nodes").alias("nodes"))
    out = told.crossJoin(pairs).crossJoin(stats)  # one row each
    enough = F.col("n_successful_seeds") >= ENOUGH
    figures = [F.when(enough, F.col(c)).alias(c) for c in [*pairs.columns, *stats.columns]]
    error = F.when(~enough, F.concat(F.lit("only "), F.col("n_successful_seeds").cast("string"), F.lit(" of the seeds succeeded"))).alias("error")
    return out.select("n_successful_seeds", "failed", *figures, error, (~enough | disintegrated(F.col("coverage"), F.col("nodes"))).alias("disintegrated"))
