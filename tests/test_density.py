"""Density clusters, the lens from neighbourhoods, and bootstraps with failing seeds, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import blocks, bootstrap, cover, density, spectral
from terrane.plans import mapper, registry

SF = "/root/testdata/sf0.001"


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def one_cell(df):
    return df.select(F.lit(42).alias("seed"), F.lit(0).alias("cx"), F.lit(0).alias("cy"), "vec_id")


def found(df, **options):
    out = {}
    for r in density.clusters(one_cell(df), df, **options).collect():
        out.setdefault(r["node"], set()).add(r["vec_id"])
    return sorted(map(sorted, out.values()))


def plain_clusters(x, least):
    """Clusters from the definition: a cluster is split at each reach from the largest down."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - x @ x.T, 12)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(least, len(d) - 1)]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])

    def parts(points, w):
        left, out = set(points), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                p = todo.pop()
                seen.add(p)
                near = {q for q in left if reach[p, q] < w}
                left -= near
                todo += near
            out.append(seen)
        return out

    def build(points, birth):
        stability, now = 0.0, set(points)
        some = sorted(now)
        for w in sorted(set(reach[np.ix_(some, some)][np.triu_indices(len(some), 1)]), reverse=True):
            split = parts(now, w)
            if len(split) == 1:
                continue
            large = [p for p in split if len(p) >= least]
            if len(large) != 1:
                stability += len(now) * (1 / w - birth)
                return stability, points, [build(p, 1 / w) for p in large]
            stability += (len(now) - len(large[0])) * (1 / w - birth)
            now = large[0]
        return stability, points, []

    def choose(cluster):
        stability, points, children = cluster
        inner = [choose(c) for c in children]
        total = sum(s for s, _ in inner)
        return (stability, [points]) if stability >= total else (total, [p for _, q in inner for p in q])

    return sorted(sorted(p) for c in build(set(range(len(x))), 0.0)[2] for p in choose(c)[1])


def blobs(seed, sizes, spreads, d=4, far=4.0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=d) * far + rng.normal(size=(n, d)) * s for n, s in zip(sizes, spreads, strict=True)])


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters_equal_the_definition(spark, seed):
    x = np.vstack([blobs(seed, (25, 30, 20), (0.2, 0.6, 1.2)), np.random.default_rng(seed).normal(size=(15, 4)) * 4])
    want = plain_clusters(x, 5)
    assert len(want) >= 2
    assert found(frame(spark, x)) == want
    assert found(frame(spark, x).repartition(5), block=24) == want  # by pairs of blocks


def test_unequal_densities_noise_and_a_lone_cluster(spark):
    x = blobs(3, (40, 40), (0.1, 1.0), far=8.0)
    got = found(frame(spark, x))
    assert len(got) == 2 and all(len(set(c) & set(range(40))) in (0, len(c)) for c in got)
    assert found(frame(spark, blobs(4, (60,), (0.3,)))) in ([], plain_clusters(blobs(4, (60,), (0.3,)), 5))
    line = np.array([[np.cos(a), np.sin(a)] for a in np.linspace(0, 1, 30)])
    assert all(len(c) < 30 for c in found(frame(spark, line)))  # the whole cell is never a cluster
    assert found(frame(spark, x[:3])) == [] and found(frame(spark, x[:1])) == []


def test_copies_weigh_and_nulls_are_noise(spark):
    x = blobs(5, (12, 12), (0.3, 0.3), far=6.0)
    x = np.vstack([x, x[:3], x[:3], np.tile(x[20], (7, 1))])
    df = frame(spark, x).union(spark.createDataFrame([(999, None)], "vec_id long, embedding array<double>"))
    got = found(df)
    assert got == found(df, block=8)
    where = {v: k for k, c in enumerate(got) for v in c}
    assert 999 not in where and all(where.get(i) == where.get(24 + i) == where.get(27 + i) for i in range(3)) and {where[i] for i in range(30, 37)} == {where[20]}


def test_neighbours(spark):
    x = blobs(6, (30, 31), (0.5, 0.5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 12)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(61) for j in np.argsort(d[i], kind="stable")[:4]}
    points = frame(spark, x).select("vec_id", F.col("embedding").alias("x"), F.lit(1).cast("long").alias("weight"))
    for block in (7, 1000):
        assert {(r["vec_id"], r["other"]) for r in blocks.neighbours(points, 4, block).collect()} == want


def test_shares_meet_their_group_few_times(spark):
    points = frame(spark, blobs(9, (200, 200), (0.5, 0.5))).select("vec_id", F.col("embedding").alias("x"), F.lit(1).cast("long").alias("weight"))
    left, right, parts = blocks.shared(points, points, [], blocks.share(400, 4))
    assert left.count() == 400 and right.count() == 400 * parts and 20 < parts <= blocks.SHARES + 2  # of 100 blocks
    assert blocks.share(10**6) == 31250 and blocks.share(10**9) == blocks.SHARE * blocks.BLOCK


@pytest.mark.parametrize("block", [16, 500])
def test_spanning_trees_across_shares(spark, block):
    x = np.vstack([blobs(10, (60, 50), (0.3, 1.0)), np.tile(np.eye(4), (20, 1)) + np.repeat(np.arange(20), 4)[:, None] * 1e-3])  # distances that tie
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    core = np.sort(np.round(1 - np.einsum("id,jd->ij", u, u), 12), axis=1)[:, 4].clip(0)
    rows = [(42, c, 0, i, [float(v) for v in x[i]], float(core[i])) for c in (0, 1) for i in range(len(x))]
    points = spark.createDataFrame(rows, "seed int, cx int, cy int, vec_id long, x array<double>, core double").repartition(5)
    a, b, w = density.spanning_tree(u, core)
    got = density.spanning_trees(points, block).collect()
    for c in (0, 1):
        mine = sorted((r["a"], r["b"]) for r in got if r["cx"] == c)
        assert len(mine) == len(x) - 1 and abs(sum(r["w"] for r in got if r["cx"] == c) - w.sum()) < 1e-9
        assert len(set(mine) & set(zip(a.tolist(), b.tolist(), strict=True))) > len(x) * 0.95


def test_lens_keeps_blobs_apart_whatever_the_partitions(spark):
    x = blobs(7, (30, 30), (0.2, 0.2), far=8.0)
    seeds = cover.seeds(spark, 42, 2)
    get = lambda df: {(r["seed"], r["vec_id"]): (r["u"], r["v"]) for r in spectral.neighbour_lens(df, seeds, many=5, block=17).collect()}
    a, b = get(frame(spark, x)), get(frame(spark, x).repartition(11))
    assert len(a) == 120 and all(np.allclose(a[k], b[k], atol=1e-8) for k in a)
    for seed in (42, 43):
        p = np.array([a[seed, i] for i in range(60)])
        inside = max(np.linalg.norm(p[s] - p[s].mean(axis=0), axis=1).max() for s in (slice(0, 30), slice(30, 60)))
        assert np.linalg.norm(p[:30].mean(axis=0) - p[30:].mean(axis=0)) > inside / 2
    assert max(abs(a[42, i][0] - a[43, i][0]) for i in range(60)) > 1e-3  # seeds differ


def test_lens_equals_power_iteration(spark):
    x = blobs(8, (20, 25), (0.6, 0.9))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 12)
    np.fill_diagonal(d, np.inf)
    near = np.zeros(d.shape, bool)
    np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :6], True, axis=1)
    near |= near.T
    degree = near.sum(axis=1)
    step = (np.eye(45) + near / np.sqrt(np.outer(degree, degree))) / 2
    got = {r["vec_id"]: (r["u"], r["v"]) for r in spectral.neighbour_lens(frame(spark, x), cover.seeds(spark, 42, 1), many=6, steps=8, every=4).collect()}
    start = spark.range(45).select(F.lit(42).alias("seed"), F.col("id").alias("node"))
    z = np.array([[r[1], r[2]] for r in start.select("node", spectral.start(1), spectral.start(2)).orderBy("node").collect()])

    def apart(z):
        t = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
        z = z - np.outer(t, t @ z)
        a = z[:, 0] / np.linalg.norm(z[:, 0])
        b = z[:, 1] - a * (a @ z[:, 1])
        return np.stack([a, b / np.linalg.norm(b)], axis=1)

    for _ in range(2):
        z = apart(z)
        for _ in range(4):
            z = step @ z
    z = apart(z) / np.sqrt(degree)[:, None]
    assert np.allclose([got[i] for i in range(45)], z, atol=1e-7)


def broken(*bad):
    def label(seed, x, weights, least):
        if seed in bad:
            raise ValueError(f"no clusters for {seed}")
        return density.condensed(seed, x, weights, least)

    return label


def test_failed_seeds_are_rows(spark):
    by_seed, points = cover.seeds(spark, 42, 3), spark.read.parquet(f"{SF}/embeddings.parquet").count()
    found = mapper.stored(mapper.nodes(spark, SF, "projection", 3, broken(43)))
    assert [(r["seed"], r["error"]) for r in bootstrap.outcomes(found, by_seed).orderBy("seed").collect()] == [(42, None), (43, "ValueError: no clusters for 43"), (44, None)]
    n = bootstrap.succeeded(found, by_seed)
    assert {r["seed"] for r in n.select("seed").distinct().collect()} <= {42, 44}
    whole = mapper.nodes(spark, SF, "projection", 3).where("seed <> 43").drop("error")
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, whole.collect()))
    row = bootstrap.stability(found, by_seed, points).first()
    assert row["n_successful_seeds"] == 2 and [f["seed"] for f in row["failed"]] == [43] and row["error"] is None
    lists = bootstrap.per_seed(spark.createDataFrame([(42, 0.5), (44, 0.7)], "seed int, rho double"), by_seed, ["rho"]).first()
    assert lists["seeds"] == [42, 43, 44] and lists["rho"] == [0.5, None, 0.7]
    most = mapper.stored(mapper.nodes(spark, SF, "projection", 3, broken(42, 44)))
    row = bootstrap.stability(most, by_seed, points).first()
    assert row["error"] == "only 1 of the seeds succeeded" and row["disintegrated"] and row["coverage"] is None
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    with pytest.raises(Exception, match="no clusters"):
        density.clusters(one_cell(vectors), vectors, label=broken(42)).collect()


def test_queries_of_density_graphs(spark):
    rows = registry.queries()["graph_stats_density"](spark, SF).collect()
    assert all(r["n_nodes"] >= 1 and 0 <= r["coverage"] <= 1 for r in rows)
    assert registry.queries()["mapper_nodes_density"](spark, SF).columns == ["seed", "node", "vec_id"]


def test_a_failed_cell_fails_the_query_of_nodes(spark, monkeypatch):
    whole = mapper.nodes
    monkeypatch.setattr(mapper, "nodes", lambda spark, d, lens, seeds: whole(spark, d, lens, 2, broken(43)))
    with pytest.raises(Exception, match="no clusters for 43"):
        registry.queries()["mapper_nodes_density"](spark, SF).collect()
