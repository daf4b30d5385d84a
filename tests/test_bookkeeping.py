"""Aligned joins, kept vectors, ledgers, p-values, and whole layers, against plain versions."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import losses, stats
from terrane.operators import agreement, align, classify, corpus, results
from terrane.plans import layers
from terrane.sources import cache, ledger, tables


def pair(spark, left, right):
    return spark.createDataFrame([(i, 1.0) for i in left], "id long, a double"), spark.createDataFrame([(i, 2.0) for i in right], "id long, b double")


def test_aligned_joins(spark):
    left, right = pair(spark, [1, 2, 3], [3, 1, 2])
    assert sorted(map(tuple, align.aligned(left, right, "id").collect())) == [(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 1.0, 2.0)]
    assert align.checked(left, right, "id").count() == 3 and align.counted(left, right, "id") == {"left": 3, "right": 3, "matched": 3, "doubled": 0}
    for a, b, said in (([1, 2, 3], [1, 2], "only on the left: 3"), ([1], [1, 4], "only on the right: 4"), ([1, 1], [1], "more than once: 1"), ([1], [1, 1], "more than once: 1"), ([1, None], [1], "null key")):
        left, right = pair(spark, a, b)
        with pytest.raises(Exception, match=said):
            align.aligned(left, right, "id").select("a").collect()  # whichever columns are read
        with pytest.raises(align.Misaligned):
            align.checked(left, right, "id")
    empty = pair(spark, [], [])
    assert align.aligned(*empty, "id").count() == align.checked(*empty, "id").count() == 0


def test_vectors_are_kept_by_what_they_are_made_of(spark, tmp_path):
    root, calls = str(tmp_path), []
    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(20)], "id string, text string")

    def encode(df):
        calls.append(df.count())
        return df.select("id", F.array(F.length("text").cast("double")).alias("embedding"))

    get = lambda df=rows, stamp="a": cache.cached_vectors(df, root, "S", "len", stamp, encode)
    first, hit = get()
    again, hit_again = get(rows.orderBy(F.desc("id")).repartition(3))
    assert not hit and hit_again and len(calls) == 1 and sorted(first.collect()) == sorted(again.collect())
    assert not get(stamp="b")[1] and not get(rows.where("id <> '3'"))[1] and len(calls) == 3
    made_of = cache.facts(rows, "S", "len", "a")
    path, _ = cache._folder(spark, root, made_of)
    folder = path.toString().removeprefix("file:")
    marker = f"{folder}/{cache.MARKER}"
    whole = open(marker).read()
    for text in ("{", '{"n": 20}', whole.replace("vectors-", "gone-")):
        with open(marker, "w") as f:
            f.write(text)
        for extra in os.listdir(folder):
            if extra.endswith(".crc"):
                os.remove(f"{folder}/{extra}")
        assert cache.found(spark, root, made_of) is None
    os.remove(marker)  # as if the writer had stopped before it
    assert cache.found(spark, root, made_of) is None and not get()[1] and get()[1]
    with pytest.raises(ValueError, match="rows gave"):
        cache.cached_vectors(rows, root, "S", "few", "a", lambda df: encode(df).limit(3))


def test_execution_goes_on_where_it_stopped(spark, tmp_path):
    plan = spark.createDataFrame([(r, f, c) for r in ("r1", "r2") for f in (0.0, 1.0) for c in ("S", "M")], "run string, fraction double, corpus string")
    trained, seen = [], []

    def evaluate(run, fraction, corpus):
        seen.append((run, fraction, corpus))
        if len(seen) == 4:
            raise RuntimeError("killed")
        return spark.createDataFrame([(fraction + len(run),)], "value double"), corpus == "M"

    one = ledger.Ledger(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        ledger.execute(one, plan, trained.append, evaluate)
    assert one.tallies(plan).first().asDict() == {"runs": 2, "trained": 1, "runs_skipped": 1, "rows_written": 3, "rows_cached": 2, "rows_skipped": 5}
    assert {(r["run"], r["left"], r["trained"]) for r in ledger.described(one, plan).collect()} == {("r1", 1, True), ("r2", 4, False)}
    two = ledger.Ledger(spark, str(tmp_path))
    assert ledger.execute(two, plan, trained.append, evaluate).first().asDict() == {"runs": 2, "trained": 1, "runs_skipped": 0, "rows_written": 5, "rows_cached": 2, "rows_skipped": 3}
    assert trained == ["r1", "r2"] and len(seen) == 9 and seen[3] == seen[4]  # the row that was claimed is done again
    assert two.results().count() == 8 and two.left(plan).isEmpty()
    three = ledger.Ledger(spark, str(tmp_path))
    assert ledger.execute(three, plan, trained.append, evaluate).first()["runs_skipped"] == 2 and len(seen) == 9
    assert ledger.execute(ledger.Ledger(spark, str(tmp_path)), plan.where("run = 'r1'"), trained.append, evaluate, force=True).first()["rows_written"] == 4
    assert three.results().count() == 8 and trained == ["r1", "r2", "r1"]


def test_p_values_in_closed_form(spark):
    rows = [(float(r), n) for r in (0.0, 0.1, -0.35, 0.7, 0.999, 1.0, -1.0) for n in (3, 4, 6)] + [(None, 5), (0.5, 2)]
    for r, n, p in spark.createDataFrame(rows, "rho double, n long").select("rho", "n", stats.correlation_p(F.col("rho"), F.col("n"))).collect():
        if r is None or n < 3:
            assert p is None
            continue
        if abs(r) == 1:
            assert p == 0
            continue
        t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
        want = {3: 1 - 2 / math.pi * math.atan(t), 4: 1 - t / math.sqrt(2 + t * t), 6: 1 - (1 + 2 / (4 + t * t)) * t / math.sqrt(4 + t * t)}[n]
        assert p == pytest.approx(want, rel=1e-9, abs=1e-13)
    one = spark.createDataFrame([(float(x),) for x in (0.5, 1.0, 3.0, 10.5, 200.0)], "x double").select("x", stats.log_gamma(F.col("x")), stats.incomplete_beta(F.col("x"), F.lit(2.0), F.lit(0.3))).collect()
    assert all(g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12) for x, g, _ in one)
    assert all(b == pytest.approx(0.3**x * (1 + 0.7 * x), rel=1e-9) for x, _, b in one)  # I_x(a, 2)
    found = spark.createDataFrame([(5, None), (5, 0.5)], "n long, rho double")
    assert [r["p"] is None for r in agreement.with_p(found).collect()] == [True, False] and agreement.with_p(found, legacy=True).first()["p"] == 1.0


def test_subsample_of_batches(spark):
    points = spark.createDataFrame([(b, i) for b in range(9) for i in range(100)], "batch long, vec_id long")
    got = losses.subsample(points, 4, 64, 1).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in got} == {0: 64, 4: 64, 8: 64}
    main, aux = spark.createDataFrame([(0, 1.0), (1, 2.0)], "batch long, loss double"), spark.createDataFrame([(0, 5.0)], "batch long, loss double")
    assert sorted(map(tuple, losses.with_auxiliary(main, aux, 0.1).collect())) == [(0, 1.0, 5.0, 1.5), (1, 2.0, None, 2.0)]


def test_rosters_and_reference_rows(spark, tmp_path):
    (tmp_path / "models.json").write_text('{"b": {"id": "x/b", "dim": 384}, "a": {"id": "x/a", "pooling": "mean"}}')
    assert list(map(tuple, tables.roster(spark, f"{tmp_path}/models.json").collect())) == [("a", "x/a", "mean", None), ("b", "x/b", None, "384")]
    (tmp_path / "ref.json").write_text('{"a": {"S": {"rho": 0.5, "gap": "?"}, "M": {"rho": 1}, "note": "text"}}')
    assert sorted(map(tuple, tables.reference_rows(spark, f"{tmp_path}/ref.json", ("rho", "gap")).collect())) == [("a", "M", 1.0, None), ("a", "S", 0.5, None)]
    tables.write_manifest(spark, f"{tmp_path}/m", commit="abc", step=3)
    said = spark.read.json(f"{tmp_path}/m").first()
    assert said["commit"] == "abc" and '"numpy"' in said["packages"] and said["step"] == 3


def test_reports_refuse_what_cannot_be_compared(spark):
    rows = [(m, "x", "S", s, 0.1 * s) for m in ("one", "two") for s in range(3)]
    schema = "machine string, model string, corpus string, seed int, rho double"
    got = results.per_seed_report(spark.createDataFrame(rows, schema)).collect()
    assert {(r["machine"], r["n"]) for r in got} == {("one", 3), ("two", 3)} and got[0]["bound"] == pytest.approx(2 * 0.1 / math.sqrt(3))
    with pytest.raises(ValueError, match="2 machines"):
        results.per_seed_report(spark.createDataFrame([*rows, ("three", "x", "S", 1, 0.0)], schema))
    with pytest.raises(Exception, match="no seed has a value: one/y/S"):
        results.per_seed_report(spark.createDataFrame([*rows, ("one", "y", "S", 1, None)], schema)).collect()
    assert results.figures_of(spark.createDataFrame([("exp1",), ("exp4",)], "exp string")) == {"made": ["rho_vs_step", "gap_vs_step", "trade_off"], "missing": ["pair_sets", "losses"]}
    with pytest.raises(ValueError, match="unknown corpus"):
        corpus.load("none", None)


def blobs(spark, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, 8)) * 6
    rows = [(k * 30 + i, [float(v) for v in centre[k] + rng.normal(size=8) * 0.3], k) for k in range(4) for i in range(30)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_layers_on_blobs(spark):
    v = blobs(spark)
    row = layers.layer1(v).first()
    assert row["lr_acc"] == 1.0 and row["n_docs"] == 120 and row["n_classes"] == 4 and row["gap"] == pytest.approx(row["within"] - row["between"]) and row["within"] > 0.95
    both = classify.router_per_corpus(v.where("label < 2"), v.where("label >= 2")).first()
    assert both["accuracy_a"] == both["accuracy_b"] == 1.0
    features = v.select("vec_id", F.slice("embedding", 1, 2).alias("z"))
    ids = v.select("vec_id", "label")
    kept = layers.stored(v.select("vec_id", "embedding"))
    got, want = layers.reanalysed(spark, kept, ids, features, seeds=3).first(), layers.layers_two_three(spark, v, features, seeds=3).first()
    assert got.asDict() == pytest.approx(want.asDict(), nan_ok=True) and got["n_successful_seeds"] == 3 and got["purity"] > 0.9
    whole = layers.checkpoint(spark, v, features, 2, seeds=3).first().asDict()
    assert {k: whole[k] for k in want.asDict()} == pytest.approx(want.asDict(), nan_ok=True) and whole["lr_acc"] == whole["accuracy_a"] == 1.0 and whole["a_to_b"] == 0 and whole["classes"] == 4
    for wrong in (kept.where("vec_id <> 5"), kept.union(kept.limit(1))):
        with pytest.raises(align.Misaligned):
            layers.reanalysed(spark, wrong, ids, features)
