"""Every registered query with SQL gives DuckDB's rows on the smallest tables; closed forms for the rest."""

import hashlib

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from terrane.functions import losses
from terrane.operators import agreement, anchor, classify, corpus, cover, encoders, geometry, graph, pairs, ranks, results
from terrane.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries that give no rows on the smallest tables: whole texts aren't shared with the benchmark, all rows are held out.
NO_ROWS = {"shared_texts", "leak_guard"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, con, name):
    said, n = check(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert not said and (n > 0 or name in NO_ROWS)


def test_plan_rows_of_a_whole_grid(spark):
    got = registry.queries()["plan_rows"](spark, SF).collect()
    assert len(got) == 48 and {r["total"] for r in got} == {6} and {r["aux"]: r["lam"] for r in got if r["lam"] < 0.2} == {"": 0.0, "dist_preserve": 0.1}
    assert any(r["todo"] < 6 for r in got) and all(0 <= r["todo"] <= 6 for r in got)


def test_largest_remainder_ties_by_name(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "subset string, n long")
    assert {r["subset"]: r["quota"] for r in corpus.largest_remainder(sizes, 4).collect()} == {"a": 2, "b": 1, "c": 1}


def test_path_of_three_nodes(spark):
    nodes = spark.createDataFrame([(0, "a", 0), (0, "a", 1), (0, "b", 1), (0, "b", 2), (0, "c", 3)], "seed int, node string, vec_id long")
    edges = spark.createDataFrame([(0, "a", "b"), (0, "b", "c")], "seed int, src string, dst string")
    r = graph.statistics(nodes, edges, 5).first()
    assert (r["n_nodes"], r["n_edges"], r["n_components"], r["b1"], r["coverage"], r["median_size"]) == (3, 2, 1, 0, 0.8, 2.0)
    assert abs(r["mean_size"] - 5 / 3) < 1e-9 and abs(r["avg_degree"] - 4 / 3) < 1e-9 and abs(r["density"] - 2 / 3) < 1e-9
    assert {(h["src"], h["dst"]): h["hops"] for h in graph.hops(nodes, edges, 3).collect()}["a", "c"] == 2


def path_graph(spark, n, docs=10, parts=1):
    """A path of n nodes, cut into parts, with so many points each."""
    nodes = spark.createDataFrame([(0, f"n{i:03d}", i * docs + k) for i in range(n) for k in range(docs)], "seed int, node string, vec_id long")
    edges = spark.createDataFrame([(0, f"n{i:03d}", f"n{i + 1:03d}") for i in range(n - 1) if (i + 1) % (n // parts)], "seed int, src string, dst string")
    return nodes, edges


def test_long_chains_settle(spark):
    nodes, edges = path_graph(spark, 500, 1)
    assert {r["component"] for r in graph.components(nodes, edges).collect()} == {"n000"}
    far = graph.hops(nodes.where("node = 'n000'").select("seed", "node"), edges.where("src < 'n030'")).groupBy().max("hops").first()[0]
    assert far == 30


def test_anchor_of_a_path_and_of_two(spark):
    rng = np.random.default_rng(4)
    for parts, pairs_ in ((1, anchor.MOST_PAIRS), (2, anchor.MOST_PAIRS)):
        nodes, edges = path_graph(spark, 50, 10, parts)
        z = spark.createDataFrame([(i, [float(i // 10 + rng.normal() * 0.1)]) for i in range(500)], "vec_id long, z array<double>")
        for legacy in (False, True):
            r = anchor.rho(nodes, edges, z, legacy).first()
            assert r["rho"] > 0.8 and r["n_pairs_used"] == pairs_
    nodes, edges = path_graph(spark, 50, 10, 2)
    z = spark.createDataFrame([(i, [float(i)]) for i in range(500)], "vec_id long, z array<double>")
    assert anchor.rho(nodes, edges, z, most_pairs=10**6).first()["n_pairs_used"] == 62_250


def test_anchor_without_enough(spark):
    nodes, edges = path_graph(spark, 3, 10)
    z = spark.createDataFrame([(i, [float(i)]) for i in range(500)], "vec_id long, z array<double>")
    assert tuple(anchor.rho(nodes, edges, z).first())[1:] == (None, 0) and tuple(anchor.rho(nodes, edges, z, legacy=True).first())[1:] == (0.0, 0)
    nodes, edges = path_graph(spark, 50, 10)
    r = anchor.rho(nodes, edges.limit(0), z).first()
    assert r["rho"] is None and r["n_pairs_used"] == 2250  # all hops are 0
    rows = spark.createDataFrame([(42, 0.1), (43, float("nan")), (44, 0.3), (45, None)], "seed int, rho double")
    s = anchor.summary(rows).first()
    assert abs(s["mean"] - 0.2) < 1e-12 and s["n"] == 2


def test_cells_are_split_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(30, 8)), 4, axis=0) + rng.normal(size=(120, 8)) * 0.3
    x[60:90] = x[60]
    vectors = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    members = cover.cover(cover.lens(vectors, cover.seeds(spark, many=2)), 2)
    whole = {tuple(r) for r in cover.clusters(members, vectors, 0.3).collect()}
    monkeypatch.setattr(cover, "BLOCK", 7)
    assert {tuple(r) for r in cover.clusters(members, vectors, 0.3).collect()} == whole and whole


@pytest.mark.parametrize("radius", [0.002, 0.01, 0.5])
def test_components_across_blocks(spark, monkeypatch, radius):
    """Arcs of a circle are components; where all points hang together, only blocks and their visitors are compared."""
    monkeypatch.setattr(cover, "BLOCK", 24)
    met = []
    monkeypatch.setattr(cover, "against", lambda *a, whole=cover.against: met.append(1) or whole(*a))
    angles = np.sort(np.random.default_rng(8).uniform(0, 2 * np.pi, 150))
    gaps = np.append(np.diff(angles), angles[0] + 2 * np.pi - angles[-1])
    cuts = np.flatnonzero(1 - np.cos(gaps) > radius)
    want = sorted(sorted((np.arange(a + 1, b + 1) % 150).tolist()) for a, b in zip(cuts, [*cuts[1:], cuts[0] + 150], strict=True)) if len(cuts) else [list(range(150))]
    vectors = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "vec_id long, embedding array<double>")
    got = {}
    for r in cover.clusters(vectors.select(F.lit(42).alias("seed"), F.lit(0).alias("cx"), F.lit(0).alias("cy"), "vec_id"), vectors, radius, 1).collect():
        got.setdefault(r["node"], []).append(r["vec_id"])
    assert sorted(map(sorted, got.values())) == want and all(k == f"0-0-{min(v)}" for k, v in got.items())
    assert bool(met) == (radius < 0.5)


def test_jackknife_closed_forms(spark):
    same = spark.createDataFrame([(i, j, 1.0) for i in range(5) for j in range(i + 1, 5)], "seed_a int, seed_b int, value double")
    assert agreement.jackknife(same).first()["se"] == 0.0
    assert agreement.jackknife(same.where("seed_b < 2")).first()["se"] is None


def test_rank_correlation(spark):
    rows = spark.createDataFrame([("g", x, x) for x in (1.0, 2.0, 2.0, 3.0)] + [("c", 1.0, 2.0), ("c", 1.0, 3.0)], "k string, x double, y double")
    got = {r["k"]: r["rho"] for r in agreement.spearman(rows, ["k"], "x", "y").collect()}
    assert abs(got["g"] - 1) < 1e-9 and got["c"] is None


def test_disintegrated_and_keys(spark):
    rows = spark.createDataFrame([(0.049, 9.0), (0.5, 4.9), (None, 9.0), (0.5, 9.0)], "c double, n double")
    assert [r[0] for r in rows.select(results.disintegrated(F.col("c"), F.col("n"))).collect()] == [True, True, True, False]
    keys = spark.createDataFrame([("0.05",), ("0.050",), ("",), (None,), ("NaN",)], "k string").select(results.canonical(F.col("k")).alias("k"))
    assert [r["k"] for r in keys.collect()] == ["0.05", "0.05", "", "", ""]


def test_upsert_of_unequal_texts(spark):
    cols = [f"`{c}` string" for c in results.IDENTITY]
    row = lambda tau, aux, gap, at: ("e", "m", "mnrl", tau, "view", aux, None, "1.0", "0", "S", gap, at)
    rows = [row("0.05", None, 1.0, 1), row("0.1", "", 2.0, 2), row("0.050", "", 3.0, 3), row("5e-2", "none", 4.0, 4)]
    got = results.upsert(spark.createDataFrame(rows, ", ".join([*cols, "gap double", "event_id long"]))).orderBy("pos").collect()
    assert [(r["pos"], r["gap"], r["tau"]) for r in got] == [(1, 4.0, "5e-2"), (2, 2.0, "0.1")]


def test_texts_of_numbers(spark):
    got = spark.createDataFrame([(0.05,), (1.0,), (20.0,), (0.123456789,)], "v double").select(results.plain(F.col("v")), results.fraction_tag(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("0.05", "0.05"), ("1", "1.0"), ("20", "20.0"), ("0.123457", "0.12")]


def test_grids(spark):
    many = lambda *a: results.expanded(spark, *a).count()
    assert many(["a", "b", "c"], ["mnrl"], [0.01, 0.05, 0.1, 0.2], ["view"], [], [], [42]) == 12
    assert many(["a"], ["mnrl"], [0.05], ["view"], ["", "none", "x"], [0.1, 0.2], [1, 2]) == 6
    with pytest.raises(ValueError):
        many([], ["mnrl"], [0.1], ["view"], [], [], [1])


def test_purity_and_partition(spark):
    nodes = spark.createDataFrame([(0, "a", 0), (0, "a", 1), (0, "a", 2), (0, "b", 3), (0, "b", 2)][:4], "seed int, node string, vec_id long")
    vectors = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "B")], "vec_id long, label string")
    r = cover.purity(nodes, vectors).first()
    assert r["weighted"] == 0.75 and abs(r["mean"] - 5 / 6) < 1e-12


def test_running_sums_in_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [("abc"[int(rng.integers(3))], int(rng.integers(50)), i) for i in range(500)] + [(None, 1, 1000), (None, 2, 1001)]
    got = ranks.running(spark.createDataFrame(rows, "g string, o int, i long"), ["g"], ["o", "i"], "before", F.col("o")).collect()
    for r in got:
        assert r["before"] == sum(o for g, o, i in rows if g == r["g"] and (o, i) < (r["o"], r["i"]))


def pair_rows(spark, shortfall=False):
    """Four subsets of forty rows around eight centres, and one whose rows are far from each other."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(4):
        centres = rng.normal(size=(8, 6)) * 3
        for i in range(40):
            z = rng.normal(size=6) * 3 * 20 if shortfall and s == 0 else centres[i % 8] + rng.normal(size=6) * 0.02
            rows.append((s * 100 + i, f"S{s}", [float(v) for v in z], "train"))
    return spark.createDataFrame(rows, "id long, subset string, z array<double>, split string")


@pytest.mark.parametrize("kind", ["random", "matched", "mismatched"])
def test_pairs_meet_quotas_and_bands(spark, kind):
    rows = pair_rows(spark)
    z = {r["id"]: np.array(r["z"]) for r in rows.collect()}
    found, report = pairs.wanted(rows, kind, 200, 3)
    got, low_high = found.collect(), pairs.BANDS[kind]
    assert len(got) == 200 == len({(r["anchor_id"], r["positive_id"]) for r in got}) and sorted(r["place"] for r in got) == list(range(200))
    for r in got:
        d = np.linalg.norm(z[r["anchor_id"]] - z[r["positive_id"]])
        assert r["anchor_id"] != r["positive_id"] and r["anchor_id"] // 100 == r["positive_id"] // 100 and low_high[0] - 1e-9 <= d <= low_high[1] + 1e-9
    for r in report.collect():
        assert (r["n"], r["quota"], r["pairs"], r["dead"]) == (40, 50, r["filled"] + 40, 0) and r["max_use"] == 2 and r["anchors"] == 40


def test_shortfall_is_filled_from_other_subsets(spark):
    found, report = pairs.wanted(pair_rows(spark, True), "matched", 100, 3)
    r = {x["subset"]: x for x in report.collect()}
    assert found.count() == 100 and (r["S0"]["pairs"], r["S0"]["shortfall"], r["S0"]["dead"]) == (0, 25, 40) and sum(x["filled"] for x in r.values()) == 25
    few = pairs.wanted(pair_rows(spark, True), "matched", 10_000, 3)[0].count()
    assert few == 3 * 40 * 4  # every row with the four others of its centre


def test_pairs_want_training_rows_only(spark):
    rows = pair_rows(spark)
    with pytest.raises(ValueError):
        pairs.wanted(rows.withColumn("split", F.when(F.col("id") == 3, "eval").otherwise("train")), "random", 10, 1)
    with pytest.raises(ValueError):
        pairs.wanted(rows, "random", 10, 1, rows.limit(1))
    for kind, n in (("none", 10), ("random", 0)):
        with pytest.raises(ValueError):
            pairs.wanted(rows, kind, n, 1)


def plain_batches(ids, size, seed):
    """Greedy sets in the order of hashes, cut into batches, until a set doesn't fill one."""
    key = lambda p: f"{hashlib.md5(f'{seed}:{p[0]}:{p[1]}'.encode()).hexdigest()}:{p[0]}:{p[1]}"
    pool, out = sorted({p for p in ids if p[0] != p[1]}, key=key), []
    while True:
        used, won = set(), []
        for p in pool:
            if not used & set(p):
                won.append(p)
                used |= set(p)
        full = len(won) // size
        if not full:
            return {(i // size, *p) for i, p in enumerate(out)}
        out += won[: full * size]
        taken = set(out)
        pool = [p for p in pool if p not in taken]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_hold_no_id_twice(spark, seed):
    rng = np.random.default_rng(seed)
    ids = [(i // 5, 100 + i) for i in range(100)] + [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(150)] + [(3, 3), (0, 100)]
    want = plain_batches(ids, 8, seed)
    for parts in (1, 9):
        got = pairs.batches(spark.createDataFrame(ids, "anchor_id long, positive_id long").repartition(parts), 8, seed).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    assert pairs.batches(spark.createDataFrame(ids[:3], "anchor_id long, positive_id long"), 8, 1).count() == 0


def test_rows_that_grow_are_not_sent_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    ids = [tuple(map(int, p)) for p in rng.integers(0, 40, (120, 2))]
    df = spark.createDataFrame(ids, "anchor_id long, positive_id long")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string")
    joined = pairs.with_texts(df, texts)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 120
    monkeypatch.setattr(pairs, "FEW_PAIRS", 0)
    assert {tuple(r) for r in pairs.batches(df, 8, 3).collect()} == plain_batches(ids, 8, 3)


def test_upper_boxes_spare_comparisons(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 8)
    rng = np.random.default_rng(3)
    z = rng.integers(-7, 8, (60, 6))[np.arange(1920) // 32] + rng.normal(size=(1920, 6)) * 0.01
    rows = spark.createDataFrame([(i, "s", [float(v) for v in r], 1920, i, 1) for i, r in enumerate(z)], "id long, subset string, z array<double>, n long, r long, need int")
    boxes = pairs.blocks(rows.select("subset", "n", "z", "r", "need"))
    near, uppers = pairs.touching(boxes, boxes, 0.0, 0.5)
    got = {tuple(r) for r in near.collect()}
    lo, hi = ({r["block"]: np.array(r[c]) for r in boxes.collect()} for c in ("lo", "hi"))
    want = {(a, c) for a in lo for c in lo if (np.maximum(np.maximum(lo[c] - hi[a], lo[a] - hi[c]), 0) ** 2).sum() <= 0.25}
    assert got == want
    n, tried = len(lo), uppers.count() << 2 * pairs.UPPER
    assert n >= 200 and tried + (n >> pairs.UPPER) ** 2 < n * n / 2


def test_linear_head_of_all_targets(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) + 1000
    x[:, 4] = x[:, 3] * 2 - 1  # depends on another one
    y = x[:, :3] @ rng.normal(size=(3, 2)) + rng.normal(size=(200, 2)) + 7
    rows = [([float(v) for v in a], float(b[0]), float(b[1])) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0), ([1.0] * 5, None, 1.0), ([1.0], 1.0, 1.0)]
    df = spark.createDataFrame(rows, "features array<double>, s double, t double").repartition(5)
    got = {r["target"]: r for r in losses.linear_head(df, ("s", "t")).collect()}
    for k, c in enumerate("st"):
        full = np.concatenate([x - 1000, np.ones((200, 1))], axis=1)
        want = y[:, k] - full @ np.linalg.lstsq(full, y[:, k], rcond=1e-10)[0]
        assert got[c]["mse"] == pytest.approx((want**2).mean(), rel=1e-6)
        assert np.mean((x @ got[c]["weights"] + got[c]["intercept"] - y[:, k]) ** 2) == pytest.approx((want**2).mean(), rel=1e-5)
    assert losses.linear_head(df.limit(0), ("s",)).count() == 0


def test_losses_in_closed_form(spark):
    same = np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0)))
    i, j, d = losses.spanning_tree(same)
    assert d.tolist() == [1.0] * 5
    rows = [(0, a, b, float(same[a, b]), float(same[a, b])) for a in range(6) for b in range(a + 1, 6)]
    order = [3, 0, 5, 1, 4, 2]
    rows += [(1, a, b, float(same[a, b]), float(same[order[a], order[b]])) for a in range(6) for b in range(a + 1, 6)]
    got = {r["batch"]: r for r in losses.tree_losses(spark.createDataFrame(rows, "batch long, a long, b long, x double, d double"), "none").collect()}
    assert got[0]["persistence"] == got[0]["topoae"] == got[1]["persistence"] == 0 and got[1]["topoae"] > 0
    for bad in ("some", None):
        with pytest.raises(ValueError):
            losses.scaled(bad, F.col("x"), F.col("d"))
    with pytest.raises(ValueError):
        losses.named("none")


def blobs(spark, k=3, sep=6.0):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(c * 40 + i, f"c{c}", [float(v) for v in rng.normal(size=16) + sep * np.eye(16)[c]]) for c in range(k) for i in range(40)], "vec_id long, label string, embedding array<float>")


def test_classifiers_on_blobs(spark):
    b = blobs(spark)
    assert classify.accuracy(b).first()["accuracy"] == 1.0 and all(r["accuracy"] == 1.0 for r in classify.accuracy(b, 3, None).collect())
    r = classify.router(b, blobs(spark).withColumn("embedding", F.transform("embedding", lambda v: (-v).cast("float")))).first()
    assert r["accuracy_a"] >= 0.9 and r["accuracy_b"] >= 0.9 and r["a_to_b"] <= 0.1 and r["b_to_a"] <= 0.1 and r["classes"] == 6
    assert geometry.within_between(b).first()["gap"] > 0
    with pytest.raises(ValueError):
        classify.stacked(b, b.withColumn("embedding", F.slice("embedding", 1, 3)))
    tiny = b.where("vec_id in (0, 1, 40, 41, 80)")
    assert sorted(r["fold"] for r in classify.stratified_folds(tiny, 5).collect()) == [0, 1, 2, 3, 4]


def test_encoders(spark):
    texts = spark.createDataFrame([(1, "Hello"), (2, "hello"), (3, ""), (4, None), (5, "other")], "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in encoders.random_projection(texts.where("text is not null")).collect()}
    assert got[1].shape == (64,) and (got[1] == got[2]).all() and not np.allclose(got[1], got[5]) and 3 in got
    hooked = encoders.encode(texts, lambda: lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()
    assert {r["id"]: r["embedding"] for r in hooked}[4] == [0.0, 1.0]
    h = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "h array<array<double>>, m array<double>")
    assert h.select(encoders.mean_pool(F.col("h"), F.col("m")).alias("v")).first()["v"] == [2.0, 3.0]
    v = spark.createDataFrame([([0.6, 0.8],)], "v array<float>")
    assert v.select(encoders.checked_unit(F.col("v"))).first()[0] is not None
    with pytest.raises(Exception, match="unit length"):
        v.select(encoders.checked_unit(F.transform("v", lambda x: (x * 2).cast("float")))).collect()


def test_trigrams_are_counted_in_their_task(spark):
    rng = np.random.default_rng(5)
    many = "".join(map(chr, rng.integers(0x4E00, 0x5000, 3000)))  # more letters than a task has a table for
    texts = [(1, "Hello, hello"), (2, ""), (3, None), (4, "\U0001f600x\U0001f600 \u0130"), (5, many), (6, "ab" * 600_000), (7, "twice"), (7, "twice so"), (None, "x"), (None, "y")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    lower = {r["id"]: r["t"] for r in df.where("id not in (7)").select("id", F.lower("text").alias("t")).collect()} | {}
    want = {}
    for i, t in texts:
        for g in [] if t is None else (lambda p: [p[k : k + 3] for k in range(len(p) - 2)])(f"  {lower.get(i, t) if i is not None and i != 7 else t}  "):
            h = want.setdefault(i, {}).setdefault(g, 0)
            want[i][g] = h + 1
    md5 = lambda seed, g: hashlib.md5(f"{seed}:{g}".encode()).hexdigest()
    counts, signed = {}, {}
    for i, grams in want.items():
        for g, n in grams.items():
            b = int(md5(3, g)[:4], 16)
            counts[i, b % 4096] = counts.get((i, b % 4096), 0) + n
            signed[i, b % 16] = signed.get((i, b % 16), 0) + (n if md5(4, g)[0] < "8" else -n)
    assert {(r["id"], r["bucket"]): r["n"] for r in encoders.bucket_counts(df).collect()} == counts
    assert {(r["id"], r["dim"]): r["x"] for r in encoders.signed_buckets(df).collect()} == signed
    each = {i: [n for (j, _), n in counts.items() if j == i] for i in want}
    assert {r["id"]: tuple(r)[1:] for r in encoders.bucket_figures(df).collect()} == {i: (len(v), sum(v), max(v)) for i, v in each.items()}
    matrix = np.random.default_rng(0).normal(0, 4096**-0.5, (4096, 64))
    got = {r["id"]: r["embedding"] for r in encoders.random_projection(df).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], sum(matrix[b] * n for (j, b), n in counts.items() if j == i), rtol=1e-5, atol=1e-4) for i in want)
    own = df.where("id < 7")
    plans = [f(own)._jdf.queryExecution().optimizedPlan().toString() for f in (encoders.bucket_figures, encoders.random_projection)]
    assert not any(w in p for p in plans for w in ("Aggregate", "Generate"))  # no list of a text's buckets, no row a trigram


@pytest.mark.parametrize("kind", ["matched", "mismatched"])
def test_pairs_search_the_whole_subset(spark, kind):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 6)) * (1.0 if kind == "matched" else 0.4)
    z[1:60:3] = z[0:60:3] + 0.01
    z[100:130] = z[100]
    rows = spark.createDataFrame([(i, "s", [float(v) for v in r]) for i, r in enumerate(z)] + [(1000 + i, "t", [float(v) for v in r]) for i, r in enumerate(z[:30])], "id long, subset string, z array<double>")
    got = pairs.build(rows, kind, 3, 7).collect()
    low, high = pairs.BANDS[kind]
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    for base, own in ((0, d), (1000, d[:30, :30])):
        fit = (own >= low) & (own <= high) & ~np.eye(len(own), dtype=bool)
        for a in range(len(own)):
            mine = sorted((r["use"], r["positive_id"] - base) for r in got if r["anchor_id"] == base + a)
            assert [u for u, _ in mine] == list(range(1, min(3, fit[a].sum()) + 1))
            assert len({p for _, p in mine}) == len(mine) and all(fit[a, p] for _, p in mine)
