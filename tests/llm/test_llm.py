"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import os
import re
import subprocess
import sys

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from terrane.llm import bpe, caps, chat, langid, media, minhash, mixing, pii, queries

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "a", "A@b.c_d@e.f 300.1.1.1 1.2.3.4", "4111 1111 1111 1111", "+1 (512) 555-4564", "\x01\\<s>[INST]", "é" * 300, "x " * 5000, "Ünï \U0001f600", "<|endoftext|>I'm"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", "clash") for i, t in enumerate(HARD)] + [(99, None, None, None, "clash"), (3, HARD[3], "en", "s", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(spark, con, name):
    said, n = check(spark, con, queries.queries()[name], queries.oracle_sql()[name], SF)
    assert not said and n > 0


def test_media_round_trip():
    rng = np.random.default_rng(0)
    data = [b"", bytes(64), rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), b"\xff" * 200, b"\0" * 40 + b"a" + b"\0" * 100 + b"bc"]
    full = [x + bytes(-len(x) % 64 or (0 if x else 64)) for x in data]
    for h, p in zip(media.decode_jpegs(media.encode_jpegs(full, [len(x) for x in data])), full, strict=True):
        assert h["coef"].astype(np.int8).tobytes()[: len(p)] == p
    with pytest.raises(ValueError):
        media.parse_markers(b"none")


def test_media_in_pieces_is_the_same_file(monkeypatch):
    data = [b"", np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8).tobytes(), b"hello world " * 900, b"x" * 64]
    full = [x + bytes(-len(x) % 64 or (0 if x else 64)) for x in data]
    whole = media.encode_jpegs(full, [len(x) for x in data])
    monkeypatch.setattr(media, "PIECE", 1024)
    assert media.encode_jpegs(full, [len(x) for x in data]) == whole
    for h, p in zip(media.decode_jpegs(whole), full, strict=True):
        assert h["coef"].astype(np.int8).tobytes()[: len(p)] == p


def test_a_text_of_20_mb_takes_little_memory():
    code = """
import resource, sys
sys.path.insert(0, sys.argv[1])
from terrane.llm import media
text = (b" ".join(str(i * i).encode() for i in range(3_000_000)))[:20_000_000]
h = media.decode_jpegs(media.encode_jpegs([text], [len(text)]))[0]
assert h["coef"].astype("int8").tobytes()[: len(text)] == text
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1000)
"""
    root = os.path.dirname(os.path.dirname(media.__file__)).rsplit("/", 1)[0]
    assert int(subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, check=True).stdout) < 600


def test_media_rows(docs):
    for r in media.media_digest(docs).collect():
        if r["doc_id"] == 99:
            assert (r["n_bytes"], r["payload_bytes"]) == (0, 64) and r["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest()


def test_chat_reads_back():
    render = chat.compile_template(chat.DEFAULT_TEMPLATE)
    for t in ["</s>[INST] ok [/INST]", "\\.\\", "<<s>", "[[INST]", "[IN[INST]ST]", "[/", "<"]:
        text, spans = render({"messages": [{"role": r, "text": t} for r in ("user", "assistant", "x]", "system")]})
        assert list(chat.read_back(text)) == [(r, t) for r in ("user", "assistant", "x]", "system")]
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t]
    assert chat.fold(chat.parse("{% if 1 + 1 == 2 %}a{% else %}b{% endif %}{{ 'c' }}")) == [("text", "ac")]
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ x.__class__ }}")


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    texts = [*HARD, "aaaaaaa" * 50, "ΑΣ İstanbul \x1c a 12 ½ 日本語", *[r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]]
    ids, counts = own.encode(texts)
    for e, a, b in zip(library.encode_batch(texts, add_special_tokens=False), own.ids_text(ids, counts), own.decode(ids, counts), strict=True):
        assert " ".join(map(str, e.ids)).encode() == a and library.decode(e.ids, skip_special_tokens=False).encode() == b


def test_bpe_of_long_texts_equals_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(1, 12, 20_000)), "Straße 12,5 % ½ " * 8000, "ab" * 2000]
    ids, counts = own.encode(texts)
    assert min(map(len, texts[:2])) > 70_000
    for e, a in zip(library.encode_batch(texts, add_special_tokens=False), own.ids_text(ids, counts), strict=True):
        assert " ".join(map(str, e.ids)).encode() == a


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 16))
    x = np.vstack([x, x[:20] + rng.normal(size=(20, 16)) * 0.05, x[:2]])
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [])]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + bad, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in caps.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i]["n_links"] for i in range(len(x))] == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in bad)


def test_language_defined_results(docs):
    got = {r["doc_id"]: r for r in langid.language_of(docs).collect()}
    assert got[99]["lang_pred"] == got[0]["lang_pred"] == got[4]["lang_pred"] == "und" and got[99]["score"] == 0
    assert langid.keep_identified(docs).columns == docs.columns


def test_language_of_many_copies_is_learned(spark):
    rows = [(f"das ist ein deutscher satz nummer {c}", "de") for c in "abcde" for _ in range(1000)] + [(f"this is an english sentence {i}", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string")
    learned = []
    fit = langid.fit
    try:
        langid.fit = lambda x, langs, *more: learned.extend(langs) or fit(x, langs, *more)
        langid.train(df, "text", "lang", F.lit(True), 20)
    finally:
        langid.fit = fit
    assert {n: learned.count(n) for n in set(learned)} == {"de": 5, "en": 20}


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = {i: float(rng.integers(1, 9)) for i in range(300)}
    b = {i: v if i % 3 else v / 2 for i, v in a.items() if i % 5}
    e, w = (np.concatenate([np.array(list(f(s)), t) for s in (a, b)]) for f, t in ((dict.keys, np.uint64), (dict.values, float)))
    s = minhash.dart_signatures(e, w, np.array([len(a), len(b)]), 2000)
    true = sum(min(a[i], b.get(i, 0)) for i in a) / sum(max(a[i], b.get(i, 0)) for i in a)
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_near_copies_and_edge_rows(spark, docs):
    words = [f"w{i}" for i in range(200)]
    near = [(1, " ".join(words)), (2, " ".join(words[:100] + ["new"] + words[101:])), (3, " ".join(words).upper()), (4, None), (5, "  "), (6, "other text")]
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert sorted(r["doc_id"] for r in minhash.keep_one_of_each(df.union(df)).collect()) == [1, 4, 6]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_mixture_meets_its_targets(spark):
    rows = [(i, "big" if i % 10 else "small", "w " * 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    used = mixing.with_copies(df, target=mixing.Target(entropy=0.9, repetition=5.0)).groupBy("source").sum("copies").collect()
    n = dict(map(tuple, used))
    p = np.array(list(n.values())) / sum(n.values())
    assert abs(-(p * np.log(p)).sum() / np.log(2) - 0.9) < 0.01 and abs(sum(n.values()) - 1000) < 3
    limited = dict(map(tuple, mixing.with_copies(df, target=mixing.Target(entropy=0.9, repetition=2.0)).groupBy("source").sum("copies").collect()))
    assert limited["small"] <= 200


def base_spans(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0 if d else False
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_against_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.pii_digest(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r["spans"].split(",")) | {""}
    assert all(not base_spans(r["text"]) for r in pii.redact(docs).collect())


def test_packed_signatures_agree_as_their_low_bits_do():
    rng = np.random.default_rng(3)
    full = rng.integers(0, 1 << 63, (20, 64), dtype=np.uint64)
    full[1, ::2] = full[0, ::2]
    low = full & np.uint64(3)
    assert (minhash.agreeing(minhash.packed(full), minhash.packed(full)) == (low[:, None] == low[None]).sum(axis=2)).all()
