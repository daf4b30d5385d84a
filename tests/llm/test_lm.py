"""The language model against a brute-force version of every contract column, and what it learns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import lm
from terrane.llm.common import string_hashes

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    """doc_id -> the contract's columns but the score."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, " "])
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws) + 1, sum(counts[w] > 0 for w in [*ws, " "]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, " "])) for i, ws in words.items()}


@pytest.mark.parametrize("share", [1_000_000, 300])
def test_contract_columns(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "HOT_SHARE", share)  # with 300, most counts come by the join
    hard = ["", None, " \t\n", "A b\x0bB\x0cc\r\nÉ é \x85x\xa0y", "word " * 3000, "w" * 3000, "x" * 200 + " " + "x" * 200, "the of and"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(hard * 3)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    want = brute(rows)
    got = lm.lm_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        held, tokens, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, train)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0


def test_no_rows_and_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(none).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.lm_scores(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["base_score"] == 0


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    shape = {"inputs": (lm.OUTPUTS + 1, lm.WIDTH), "near": (lm.BEFORE, lm.WIDTH), "heads": (lm.GROUPS, lm.WIDTH), "head_bias": (lm.GROUPS,), "outputs": (lm.OUTPUTS, lm.WIDTH), "bias": (lm.OUTPUTS,)}
    p = {k: rng.normal(size=s).astype(np.float32) for k, s in shape.items()}
    before = np.tile([[5, lm.OUTPUTS, 77]], (lm.OUTPUTS, 1))
    assert abs(np.exp(lm.log_probabilities(p, before, np.arange(lm.OUTPUTS))).sum() - 1) < 1e-4
    assert sorted(lm.outcome(np.arange(lm.OUTPUTS))) == list(range(lm.OUTPUTS))


def gains(df):
    rows = lm.lm_scores(df).groupBy("held_out").agg((F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).alias("gain")).collect()
    return {r["held_out"]: r["gain"] for r in rows}


def test_better_than_single_words_however_the_table_is_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_parts = [gains(docs.repartition(n)) for n in (1, 4, 16)]
    for got in by_parts:
        assert got[False] > 0.25 and got[True] > 0.55
        assert got == pytest.approx(by_parts[0], rel=1e-3)  # sums in another order


def test_many_shards_learn_nearly_as_much(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = gains(docs)
    monkeypatch.setattr(lm, "SHARD", 1 << 14)
    many = gains(docs)
    assert many[False] > 0.15 and many[True] > 0.5 and one[False] > many[False]


def test_learns_what_follows_from_context(spark):
    """Two languages of fifty words each: the tokens before tell which one it is."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 50, 200))) for i in range(1000)]
    r = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).first()
    assert r["s"] - r["b"] > 0.7 * math.log10(2)


def test_contexts_and_their_slices(monkeypatch):
    flat, sizes = np.arange(1, 11, dtype=np.int32), np.array([4, 0, 1, 5])
    whole = lm.contexts(flat, sizes)
    assert whole[3].tolist() == [3, 2, 1] and whole[4].tolist() == [lm.OUTPUTS] * 3 and whole[6].tolist() == [6, lm.OUTPUTS, lm.OUTPUTS]
    monkeypatch.setattr(lm, "TOKENS", 3)
    assert (np.concatenate([lm._around(flat, sizes, a)[:3] for a in range(0, 10, 3)]) == whole).all()


def test_words_and_their_classes():
    words = pa.array(["abc", "xabc", "bc", "c", "é", "abd"])
    classes = lm.other_classes(words)
    assert classes[0] == classes[1] and len(set(classes.tolist())) >= 4 and lm.IS_CLASS[classes].all()
    assert (string_hashes(words.slice(2)) == string_hashes(words)[2:]).all()
    index, found, n = lm.split_words(pa.array(["Ab É", " É  b c", None]).slice(1))
    assert [found[int(i)].as_py() for i in index] == ["É", "b", "c"] and n.tolist() == [3, 0]
