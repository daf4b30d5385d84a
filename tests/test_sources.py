"""Scans, sinks, settings and the streamed result table."""

import json

import pytest
from pyspark.sql import functions as F

from terrane.operators.results import IDENTITY
from terrane.sources import tables
from terrane.streaming import upserts


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_trees_of_questions(spark, tmp_path):
    put(tmp_path / "t/bio/deep_read.json", [{"question": "a?"}, {"question": " "}, {"question": None}, {"question": "b?"}])
    put(tmp_path / "t/chem/deep_read.json", [{"question": "c?"}])
    got = {r["id"]: (r["question"], r["source_subset"]) for r in tables.question_tree(spark, f"{tmp_path}/t", "sci").collect()}
    assert got == {"sci-bio-deep-read-1": ("a?", "bio"), "sci-bio-deep-read-4": ("b?", "bio"), "sci-chem-deep-read-1": ("c?", "chem")}
    put(tmp_path / "f/law.json", [{"question": "d?"}])
    r = tables.question_tree(spark, f"{tmp_path}/f", "mm", depth=1).first()
    assert (r["id"], r["source_competency"]) == ("mm-law-1", None)
    schema = "id string, question string, source_subset string, source_competency string"
    for _ in range(2):  # flattened and cached, then read from the cache
        assert tables.corpus_source(spark, None, f"{tmp_path}/cache", f"{tmp_path}/t", "sci", schema).count() == 3
    put(tmp_path / "own.jsonl", json.dumps({"id": "x", "question": "é"}))
    assert tables.corpus_source(spark, f"{tmp_path}/own.jsonl", f"{tmp_path}/cache", "none", "sci", schema).first()["question"] == "é"


def test_json_lines_and_hashes(spark, tmp_path):
    tables.write_json_lines(spark.createDataFrame([(1, "naïve ñ")], "i long, t string").coalesce(1), f"{tmp_path}/deep/out")
    assert tables.json_lines(spark, f"{tmp_path}/deep/out", "i long, t string").first()["t"] == "naïve ñ"
    put(tmp_path / "a.bin", "abc")
    assert tables.file_hashes(spark, f"{tmp_path}/a.bin").first()["sha256"].startswith("ba7816bf")


def test_result_files(spark, tmp_path):
    put(tmp_path / "b.csv", "exp,gap\nexp2,NA\n")
    put(tmp_path / "a.csv", "exp,gap,new\nexp1,0.5,x\n")
    got = tables.result_files(spark, [f"{tmp_path}/{n}.csv" for n in ("b", "missing", "a")]).collect()
    assert sorted((r["exp"], r["gap"], r["new"]) for r in got) == [("exp1", "0.5", "x"), ("exp2", "NA", "")]
    with pytest.raises(FileNotFoundError):
        tables.result_files(spark, [f"{tmp_path}/none.csv"])
    for i in range(2):
        tables.append_rows(spark.createDataFrame([(i, 0.5)], "step int, loss double"), f"{tmp_path}/log")
    assert tables.published(spark, f"{tmp_path}/log", "step", ("loss",)).count() == 2


def test_metric_documents(spark, tmp_path):
    for m, c, k in (("m1", "S", "k1"), ("m1", "M", "k1"), ("m2", "S", "k2")):
        put(tmp_path / m / f"{c}.metrics.json", {"gap": 0.5, "cache_key": k})
    put(tmp_path / "m2/M.metrics.json", "{not json")
    rows = tables.metric_files(spark, str(tmp_path), "gap double, cache_key string")
    assert {(r["model"], r["corpus"], r["gap"]) for r in rows.collect()} == {("m1", "S", 0.5), ("m1", "M", 0.5), ("m2", "S", 0.5), ("m2", "M", None)}
    assert tables.cached_metrics(spark, str(tmp_path), "gap double, cache_key string", "k1").count() == 2
    keys = tables.keys_of_all(rows.where("gap is not null").select("corpus", F.col("model").alias("key")))
    assert [r["key"] for r in keys.collect()] == ["m1"]


def test_settings(spark, tmp_path):
    put(tmp_path / "base.json", {"a": {"x": 1, "y": [1, 2]}, "b": 1})
    put(tmp_path / "exp.json", {"base": "base.json", "a": {"y": [3]}, "c": 2})
    got = tables.settings(spark, f"{tmp_path}/exp.json")
    assert got == {"a": {"x": 1, "y": [3]}, "b": 1, "c": 2}
    assert tables.fingerprint(got) == tables.fingerprint(got | {"n_workers": 8}) != tables.fingerprint(got | {"b": 2})
    tables.write_manifest(spark, f"{tmp_path}/manifest", seed=42, extra={"k": 1})
    r = spark.read.json(f"{tmp_path}/manifest").first()
    assert r["seed"] == 42 and r["extra"] == '{"k":1}'.replace(":", ": ") and r["spark"] == spark.version


def test_streamed_upserts(spark, tmp_path):
    names = list(IDENTITY)
    schema = ", ".join([*[f"`{c}` string" for c in names], "gap double", "event_id long"])

    def row(tau, gap, at):
        return json.dumps(dict.fromkeys(names, "k") | {"tau": tau, "gap": gap, "event_id": at})

    where = {n: f"{tmp_path}/{n}" for n in ("in", "table", "state")}
    batches = [[row("0.05", 1.0, 1), row("0.1", 2.0, 2)], [row("0.050", 3.0, 3)], [row("0.2", 4.0, 4)], [row("0.1", 5.0, 5)]]
    for i, rows in enumerate(batches):
        put(tmp_path / "in" / f"{i}.json", "\n".join(rows))
        upserts.merge_batches(spark, where["in"], schema, where["table"], where["state"]).awaitTermination()
    got = upserts.current(spark, where["table"], schema, 3).collect()
    assert {(r["tau"], r["gap"], r["pos"]) for r in got} == {("0.050", 3.0, 1), ("0.1", 5.0, 2), ("0.2", 4.0, 4)}
    assert (tmp_path / "table/data/v3").exists()
