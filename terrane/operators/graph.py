"""Components, hop distances and statistics of the cluster graphs, for all seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.tables import release, stored

#: Most labels, of some MB, that are broadcast in a round of ``min_labels``; beyond it the joins are shuffled.
FEW_LABELS = 20_000


def min_labels(edges: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(key, node, component): of every node with an edge (key, src, dst) the smallest node that can be reached.

    Each round takes the smallest label of a node and its neighbours, then the label of that label, so that labels
    jump along chains.  Labels spread by joins on one endpoint and an aggregation on the other: a hub's rows are summed
    before the shuffle, and its join can be split; few labels are broadcast instead, which leaves a round one shuffle.
    Every round is stored, with the labels before it, and the one before deleted; a round with a change lowers a label,
    so rounds end.
    """
    k, apart = list(key), edges.where("src <> dst")
    both = stored(apart.select(*k, "src", "dst").union(apart.select(*k, "dst", "src")).distinct())
    labels = both.groupBy(*k, F.col("src").alias("node")).agg(F.min("dst").alias("least")).select(*k, "node", F.least("node", "least").alias("component"))
    labels = stored(labels, both.count())
    n = labels.count()  # all rounds have the same nodes
    sent = F.broadcast if n <= FEW_LABELS else lambda df: df.hint("merge")  # else broadcast by the size of its files, which is small
    while True:
        near = both.join(sent(labels.select(*k, F.col("node").alias("dst"), "component")), [*k, "dst"]).select(*k, F.col("src").alias("node"), "component", F.when(F.lit(False), F.col("component")).alias("old"))
        seen = near.union(labels.select(*k, "node", "component", F.col("component").alias("old"))).groupBy(*k, "node").agg(F.min("component").alias("next"), F.min("old").alias("old"))
        up = sent(labels.select(*k, F.col("node").alias("next"), F.col("component").alias("up")))
        new = stored(seen.join(up, [*k, "next"], "left").select(*k, "node", F.least("next", F.coalesce("up", "next")).alias("component"), "old"), n)
        still = new.where("component <> old").isEmpty()
        release(labels)
        labels = new
        if still:
            release(both)
            out = labels.drop("old")
            out.stored_path = labels.stored_path
            return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node, component): the smallest node that can be reached."""
    labels = min_labels(edges, ("seed",))
    return nodes.select("seed", "node").distinct().join(labels, ["seed", "node"], "left").select("seed", "node", F.coalesce("component", "node").alias("component"))


def hops(sources: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, src, dst, hops): shortest paths from the nodes ``sources`` (seed, node), of up to ``most`` edges.

    A frontier is stored and takes only nodes that neither it nor the one before holds, which in an undirected graph
    are all that could come again.  It stops when a frontier is empty.  Rows are sources times nodes that they reach.
    """
    edge = stored(edges.select("seed", "src", "dst").union(edges.select("seed", "dst", "src")).distinct().toDF("seed", "dst", "next"))
    last = frontier = stored(sources.select("seed", F.col("node").alias("src"), F.col("node").alias("dst")).distinct())
    found, h = frontier.withColumn("hops", F.lit(0)), 0
    while most is None or h < most:
        h += 1
        reached = frontier.join(edge, ["seed", "dst"]).select("seed", "src", F.col("next").alias("dst")).distinct()
        before = frontier if last is frontier else frontier.union(last)
        last, frontier = frontier, stored(reached.join(before, ["seed", "src", "dst"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.union(frontier.withColumn("hops", F.lit(h)))
    return found


def statistics(nodes: DataFrame, edges: DataFrame, points: int) -> DataFrame:
    """Per seed: nodes, edges, components, coverage, mean and median size, largest component's share, b1, degree, density."""
    sizes = nodes.groupBy("seed", "node").agg(F.count("*").alias("n"))
    s = sizes.groupBy("seed").agg(F.count("*").alias("n_nodes"), F.avg("n").alias("mean_size"), F.expr("percentile(n, 0.5)").alias("median_size"))
    covered = nodes.groupBy("seed").agg((F.countDistinct("vec_id") / F.lit(points)).alias("coverage"))
    e = edges.groupBy("seed").agg(F.count("*").alias("n_edges"))
    c = components(nodes, edges).groupBy("seed", "component").agg(F.count("*").alias("n")).groupBy("seed").agg(F.count("*").alias("n_components"), F.max("n").alias("largest"))
    all_ = s.join(covered, "seed").join(c, "seed").join(e, "seed", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    v, n = F.col("n_nodes"), F.col("n_edges")
    return all_.select("seed", "n_nodes", "n_edges", "n_components", "coverage", "mean_size", "median_size", (F.col("largest") / v).alias("largest_share"), F.greatest(n - v + F.col("n_components"), F.lit(0)).alias("b1"), (2 * n / v).alias("avg_degree"), F.when(v > 1, 2 * n / (v * (v - 1))).otherwise(0.0).alias("density"))
