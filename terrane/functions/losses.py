"""Forward values of training losses over batches of pairs, as aggregations; spanning trees inside a batch's task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.vectors import as_doubles, distance, dot, hash_rank, unit


def batched(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(batch, i, ea, ep) of pairs (batch, i, anchor_id, positive_id), with unit vectors of (vec_id, embedding)."""
    side = lambda key, out: vectors.select(F.col("vec_id").alias(key), unit(as_doubles(F.col("embedding"))).alias(out))
    return pairs.join(side("anchor_id", "ea"), "anchor_id").join(side("positive_id", "ep"), "positive_id").select("batch", "i", "ea", "ep")


def in_batch(rows: DataFrame) -> DataFrame:
    """(batch, a, p, c): cosines of every anchor with every positive of its batch; rows grow with pairs times the batch."""
    return rows.select("batch", F.col("i").alias("a"), "ea").join(rows.select("batch", F.col("i").alias("p"), "ep"), "batch").select("batch", "a", "p", dot(F.col("ea"), F.col("ep")).alias("c"))


def cosine_stats(cosines: DataFrame) -> DataFrame:
    """(batch, pos_cos, neg_cos): mean cosine of an anchor with its own positive, and with others' (NULL for one pair)."""
    return cosines.groupBy("batch").agg(F.avg(F.when(F.col("a") == F.col("p"), F.col("c"))).alias("pos_cos"), F.avg(F.when(F.col("a") != F.col("p"), F.col("c"))).alias("neg_cos"))


def contrastive(cosines: DataFrame, tau: float = 0.05) -> DataFrame:
    """(batch, loss): mean negative log share of an anchor's own positive among those of its batch."""
    each = cosines.groupBy("batch", "a").agg(F.log(F.sum(F.exp(F.col("c") / tau - 1 / tau))).alias("z"), F.max(F.when(F.col("a") == F.col("p"), F.col("c") / tau - 1 / tau)).alias("own"))
    return each.groupBy("batch").agg(F.avg(F.col("z") - F.col("own")).alias("loss"))


def triplet(rows: DataFrame, margin: float = 5.0) -> DataFrame:
    """(batch, loss) of (batch, ea, ep, en): mean excess of the anchor's distance to its positive over that to its negative, with a margin."""
    return rows.groupBy("batch").agg(F.avg(F.greatest(distance(F.col("ea"), F.col("ep")) - distance(F.col("ea"), F.col("en")) + margin, F.lit(0.0))).alias("loss"))


def cosent(rows: DataFrame, scale: float = 20.0) -> DataFrame:
    """(batch, loss) of (batch, ea, ep, en): log(1 + sum of exp(scale (negative's cosine - positive's cosine))) over all
    positives and negatives of the batch; the sum over both is a product of two sums."""
    high = rows.groupBy("batch").agg(F.log(F.sum(F.exp(scale * (dot(F.col("ea"), F.col("en")) - 1)))).alias("n"), F.log(F.sum(F.exp(-scale * (dot(F.col("ea"), F.col("ep")) + 1)))).alias("p"))
    x = F.col("n") + F.col("p") + 2 * scale  # log of the sum of all exps
    return high.select("batch", (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def scaled(mode: str | float, live: Column, reference: Column) -> Column:
    """What reference distances are multiplied by, as an aggregate: "match_mean", "none" or a number."""
    if isinstance(mode, (int, float)) and not isinstance(mode, bool):
        return F.lit(float(mode))
    if mode == "none":
        return F.lit(1.0)
    if mode == "match_mean":
        return F.when(F.avg(reference) > 0, F.avg(live) / F.avg(reference)).otherwise(1.0)
    raise ValueError(f"unknown reference scale {mode!r}")


def distances(rows: DataFrame, size: int = 32) -> DataFrame:
    """(batch, a, b, x, d): cosine distances (0 at least) and feature distances of all points a < b of a batch, from
    (batch, i, e, z), e being unit vectors and z standardized features."""
    a = rows.select("batch", F.col("i").alias("a"), F.col("e").alias("ea"), F.col("z").alias("za"))
    b = rows.select("batch", F.col("i").alias("b"), F.col("e").alias("eb"), F.col("z").alias("zb"))
    return a.join(b, "batch").where("a < b").select("batch", "a", "b", F.greatest(1 - dot(F.col("ea"), F.col("eb")), F.lit(0.0)).alias("x"), distance(F.col("za"), F.col("zb")).alias("d"))


def distance_preservation(pairs: DataFrame, mode: str | float = "match_mean") -> DataFrame:
    """(batch, loss): mean squared difference of both distances, the features' brought to scale."""
    scale = pairs.groupBy("batch").agg(scaled(mode, F.col("x"), F.col("d")).alias("s"))
    return pairs.join(scale, "batch").groupBy("batch").agg(F.avg(F.pow(F.col("x") - F.col("s") * F.col("d"), 2)).alias("loss"))


def subsample(points: DataFrame, every: int, most: int = 64, seed: int = 0, name: str = "vec_id") -> DataFrame:
    """(batch, <name>): up to ``most`` points of every ``every``-th batch, by hash; a batch is of bounded size."""
    at = F.row_number().over(W.partitionBy("batch").orderBy(hash_rank(seed, F.col("batch"), F.col(name)), name))
    return points.where(F.col("batch") % every == 0).select("batch", name, at.alias("at")).where(F.col("at") <= most).drop("at")


def with_auxiliary(main: DataFrame, auxiliary: DataFrame, weight: float) -> DataFrame:
    """(batch, loss, aux, total): losses of all batches, with the auxiliary ones of those that have one."""
    both = main.join(auxiliary.select("batch", F.col("loss").alias("aux")), "batch", "left")
    return both.select("batch", "loss", "aux", (F.col("loss") + weight * F.coalesce("aux", F.lit(0.0))).alias("total"))


def spanning_tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j) of the least spanning tree of a distance matrix and their lengths, by Prim."""
    n = len(d)
    inside, best, near = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = (d[at] < best) & ~inside
        best[closer], near[closer] = d[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((near[at], at))
    i, j = np.array(edges, int).reshape(-1, 2).T
    return i, j, d[i, j]


def tree_losses(pairs: DataFrame, mode: str | float = "match_mean", top_k: int | None = 32) -> DataFrame:
    """(batch, persistence, topoae): of every batch's ``distances``, in a task of its own (batches are of bounded size).

    persistence: mean squared difference of both spaces' sorted tree edges, the ``top_k`` longest.  topoae: mean squared
    differences of both distances at the one tree's edges plus those at the other's.  A batch of one point has no pairs.
    """
    scale = pairs.groupBy("batch").agg(scaled(mode, F.col("x"), F.col("d")).alias("s"))
    rows = pairs.join(scale, "batch").select("batch", "a", "b", "x", (F.col("d") * F.col("s")).alias("d"))

    def task(key, t):
        names, place = np.unique(np.concatenate((t["a"].to_numpy(), t["b"].to_numpy())), return_inverse=True)
        half, n = len(place) // 2, len(names)
        live, ref = np.zeros((n, n)), np.zeros((n, n))
        for m, c in ((live, "x"), (ref, "d")):
            m[place[:half], place[half:]] = t[c].to_numpy()
            m += m.T
        (il, jl, dl), (ir, jr, dr) = spanning_tree(live), spanning_tree(ref)
        top = slice(None, top_k)
        persistence = float(np.mean((np.sort(dl)[::-1][top] - np.sort(dr)[::-1][top]) ** 2))
        topoae = float(np.mean((live[ir, jr] - dr) ** 2) + np.mean((dl - ref[il, jl]) ** 2))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([persistence]), pa.array([topoae])], ["batch", "persistence", "topoae"])

    return rows.groupBy("batch").applyInArrow(task, "batch bigint, persistence double, topoae double")


def named(name: str):
    """A loss by its name."""
    found = {"mnrl": contrastive, "triplet": triplet, "cosent": cosent, "dist_preserve": distance_preservation, "persist0_h0": tree_losses, "topoae_h0": tree_losses}
    if name not in found:
        raise ValueError(f"unknown loss {name!r}")
    return found[name]


def linear_head(rows: DataFrame, targets: tuple[str, ...], features: str = "features", ridge: float = 0.0) -> DataFrame:
    """(target, mse, weights, intercept): linear maps from the array ``features`` to all targets, by least squares.

    One pass: tasks add up the products of features, of targets and of both, shifted by the first row's values so that
    nothing cancels, and hand on d + targets rows each; Spark sums them and one factorisation in a task serves all
    targets.  Where features depend on each other it gives the shortest weights.  Rows with a null are left out, as are
    arrays that aren't as long as most (the longer of equally many); no rows give no targets.
    """
    whole = rows.select(F.col(features).cast("array<double>").alias("x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"))
    whole = whole.where("x is not null and size(x) > 0 and not exists(x, v -> v is null) and not exists(y, v -> v is null)")
    sizes = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "target string, mse double, weights array<double>, intercept double")
    d, k = sizes["d"], len(targets)
    whole = whole.where(F.size("x") == d)
    origin = np.array([*(first := whole.select("x", "y").first())["x"], *first["y"]])

    def products(batches):
        total = np.zeros((1 + d + k, 1 + d + k))
        for b in batches:
            z = np.concatenate([b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (0, 1)], axis=1) - origin
            z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(1 + d + k), 1 + d + k), pa.int32()), pa.array(np.tile(np.arange(1 + d + k), 1 + d + k), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    sums = whole.select("x", "y").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))

    def solve(key, t):
        m = np.zeros((1 + d + k, 1 + d + k))
        m[t["i"].to_numpy(), t["j"].to_numpy()] = t["v"].to_numpy()
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        c = m[1:, 1:] / n - np.outer(mean, mean)
        w = np.linalg.pinv(c[:d, :d] + ridge * np.eye(d), rcond=1e-12, hermitian=True) @ c[:d, d:]
        mse = np.diag(c)[d:] - 2 * np.einsum("ij,ij->j", w, c[:d, d:]) + np.einsum("ij,ik,kj->j", w, c[:d, :d], w)
        intercept = (mean + origin)[d:] - (mean + origin)[:d] @ w
        return pa.table([pa.array(list(targets)), pa.array(np.maximum(mse, 0)), pa.array(w.T.tolist(), pa.list_(pa.float64())), pa.array(intercept)], ["target", "mse", "weights", "intercept"])

    return sums.groupBy(F.lit(0).alias("all")).applyInArrow(solve, "target string, mse double, weights array<double>, intercept double")  # (1 + d + k)^2 rows
