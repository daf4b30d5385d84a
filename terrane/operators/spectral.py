"""A lens from neighbourhoods: two smooth coordinates on the graph of nearest neighbours, for many seeds at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.vectors import hash_rank
from terrane.operators.blocks import BLOCK, neighbours
from terrane.sources.tables import release, stored

MANY, STEPS, EVERY, DIGITS = 15, 24, 6, 9


def start(axis: int) -> Column:
    """A number in [-1, 1) by hash of seed and id."""
    return F.conv(F.substring(hash_rank(axis, F.col("seed"), F.col("node")), 1, 8), 16, 10).cast("double") / 2.0**31 - 1


def apart(state: DataFrame) -> DataFrame:
    """``state`` (seed, node, degree, u, v) with u and v made orthogonal to the constant direction, which is sqrt(degree), to
    each other, and of length one; from six sums a seed."""
    t = F.sqrt("degree")
    s = state.groupBy("seed").agg(*[F.sum(a * b).alias(n) for n, a, b in (("tt", t, t), ("ut", F.col("u"), t), ("vt", F.col("v"), t), ("uu", F.col("u"), F.col("u")), ("uv", F.col("u"), F.col("v")), ("vv", F.col("v"), F.col("v")))])
    uu, uv, vv = (F.col(f"{a}{b}") - F.col(f"{a}t") * F.col(f"{b}t") / F.col("tt") for a, b in ("uu", "uv", "vv"))
    s = s.select("seed", "tt", "ut", "vt", F.greatest(uu, F.lit(1e-300)).alias("uu"), uv.alias("uv"), vv.alias("vv"))
    s = s.withColumn("rest", F.greatest(F.col("vv") - F.col("uv") * F.col("uv") / F.col("uu"), F.lit(1e-300)))
    rows = state.join(F.broadcast(s), "seed")  # a row a seed
    u = F.col("u") - t * F.col("ut") / F.col("tt")
    v = F.col("v") - t * F.col("vt") / F.col("tt") - u * F.col("uv") / F.col("uu")
    return rows.select("seed", "node", "degree", (u / F.sqrt("uu")).alias("new_u"), (v / F.sqrt("rest")).alias("new_v")).toDF("seed", "node", "degree", "u", "v")


def neighbour_lens(vectors: DataFrame, by_seed: DataFrame, many: int = MANY, steps: int = STEPS, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """(seed, vec_id, u, v): each seed's random numbers, smoothed along the graph of the ``many`` nearest by cosine distance.

    The graph joins two points if either is among the other's nearest.  ``steps`` times a point's numbers are averaged
    with its neighbours', both sides weighted by degree (power iteration of the lazy normalised adjacency, as a join of
    edges and numbers), and every ``every`` steps the two numbers are made orthogonal and the round is stored.  Points of
    parts that hang together loosely end up apart; how far depends on the seed, as the iteration isn't run to its end.
    Equal vectors are one point; null vectors have no row; results are rounded to DIGITS digits.
    """
    own = vectors.where("embedding is not null").select("vec_id", F.xxhash64("embedding").alias("h"), F.col("embedding").alias("x"))
    reps = stored(own.groupBy("h", "x").agg(F.min("vec_id").alias("node"), F.lit(1).cast("long").alias("weight")))
    owner = stored(own.join(reps, ["h", "x"]).select("vec_id", "node"))
    near = stored(neighbours(reps.select(F.col("node").alias("vec_id"), "x", "weight"), many, block).select("vec_id", "other"))
    pairs = stored(near.select(F.col("vec_id").alias("src"), F.col("other").alias("dst")).union(near.select("other", "vec_id")).distinct())
    degree = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("degree"))
    to = degree.select(F.col("node").alias("dst"), F.col("degree").alias("far"))
    edges = stored(pairs.join(degree.withColumnRenamed("node", "src"), "src").join(to, "dst").select("src", "dst", (1 / F.sqrt(F.col("degree") * F.col("far"))).alias("w")))
    nodes = reps.select("node").join(degree, "node", "left").select("node", F.coalesce("degree", F.lit(1.0)).alias("degree"))
    state = stored(apart(nodes.crossJoin(F.broadcast(by_seed)).select("seed", "node", "degree", start(1).alias("u"), start(2).alias("v"))))  # seeds are few
    release(pairs, near)
    for first in range(0, steps, every):
        moved = state
        for _ in range(min(every, steps - first)):
            far = moved.select("seed", F.col("node").alias("dst"), "u", "v")
            sums = edges.join(far, "dst").groupBy("seed", F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("u")).alias("su"), F.sum(F.col("w") * F.col("v")).alias("sv"))
            half = lambda c: ((F.col(c) + F.coalesce(f"s{c}", F.lit(0.0))) / 2).alias(c)
            moved = moved.join(sums, ["seed", "node"], "left").select("seed", "node", "degree", half("u"), half("v"))
        new = stored(apart(stored_once := stored(moved)))
        release(state, stored_once)
        state = new
    release(edges, reps)
    at = lambda c: F.round(F.col(c) / F.sqrt("degree"), DIGITS).alias(c)
    return state.join(owner, "node").select("seed", "vec_id", at("u"), at("v"))
