"""Queries of the cluster graph with density clusters in the cells of a lens from neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import bootstrap, cover, density, graph, spectral
from terrane.plans import registry as r
from terrane.plans.base import query, rounded
from terrane.sources.tables import stored, table

LENSES = {"projection": cover.lens, "neighbours": spectral.neighbour_lens}
#: Seeds of the queries with a lens from neighbourhoods.
SEEDS = 5


def nodes(spark, d, lens: str = "neighbours", seeds: int = SEEDS, label=density.condensed):
    """(seed, node, vec_id, error) of a lens of LENSES, the cover's cells and density clusters in them."""
    vectors = table(spark, d, "embeddings")
    points = LENSES[lens](vectors, cover.seeds(spark, many=seeds))
    return density.clusters_or_errors(cover.cover(points, r.CELLS), vectors, label=label)


@query()
def neighbour_lens_points(spark, d):
    return rounded(spectral.neighbour_lens(table(spark, d, "embeddings"), cover.seeds(spark, many=SEEDS)), "u", "v")


@query()
def mapper_nodes_density(spark, d):
    return density.or_raise(nodes(spark, d, "projection", cover.SEEDS))


@query()
def graph_stats_density(spark, d):
    n = stored(bootstrap.succeeded(nodes(spark, d), cover.seeds(spark, many=SEEDS)))
    out = graph.statistics(n, stored(cover.nerve(n)), table(spark, d, "embeddings").count())
    return rounded(out, "coverage", "mean_size", "largest_share", "avg_degree", "density")


@query()
def bootstrap_stability(spark, d):
    """One row of agreement over the seeds, with the seeds that failed."""
    found = stored(nodes(spark, d))
    out = bootstrap.stability(found, cover.seeds(spark, many=SEEDS), table(spark, d, "embeddings").count())
    return rounded(out.withColumn("failed", F.size("failed")), *[f.name for f in out.schema if f.dataType.simpleString() == "double"])
