"""Secret scans against a plain version of the fixed patterns, and planted secrets among ordinary code."""

import hashlib
import random
import re
import string

import pytest

from terrane.llm import queries, secret_scan

SF = "/root/testdata/sf0.001"
ALNUM = string.ascii_letters + string.digits
PROSE = "The profile of a user is read from the cache, then the manager returns the session to the factory of handlers. "


def random_text(seed, n, letters=ALNUM):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def plain(text):
    found = []
    for k, (p, keep) in enumerate([
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]):
        found += [(m.start(), k, m.end()) for m in p.finditer(text) if keep(m)]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in sorted(found))


HARD = [
    None, "", "é\U0001f600 token = abcdefgh", "token=short", "API_KEY: 'x.y/z+w=-_9'", "apikey==aaaaaaaa", "TOKEN\n=abcdefgh", "toKen=abcdefgh", "paſsword=abcdefgh", "AKIA" + "A" * 12, "AKIAAKIA" + "B" * 7 + "!", "f" * 31, "F" * 40,
    "0" * 32 + "g" + "1" * 33, "token = " + "a1" * 20, "passwordpassword: secret=token:abcdefgh", "x" * 300_000 + " secret: " + "b" * 9, "token    " * 3000, "A" * 100_000,
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(HARD + HARD[2:4])], "doc_id long, text string, spans string, n_hex int")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    got = secret_scan.secrets_digest(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(f"{k}:") for k in secret_scan.KINDS[:3])
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("novel")) == want
    assert secret_scan.secrets_digest(df.limit(0)).count() == 0


def test_query_equals_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op12_secrets"](spark, SF).collect()
    assert len(got) == len(texts) and all(r["base_sha256"] == hashlib.sha256(plain(texts[r["doc_id"]]).encode()).hexdigest() for r in got)


PLANTED = [
    ("aws_secret_access_key => ", random_text(1, 40)), ("", "ghp_" + random_text(2, 36)), ("Authorization: Bearer ", random_text(3, 48)), ("client key: '", random_text(5, 24)), ("auth=", random_text(6, 24, "0123456789abcdef")),
    ("postgres://admin:", random_text(4, 14) + "@db/x"), ("private_key -> ", random_text(7, 64)), ("pin ", random_text(8, 24, string.digits)), ("pwd is ", random_text(9, 12)), ("", "sk_live_" + random_text(10, 24)), ("credentials: ", random_text(11, 12)),
    ("-----BEGIN RSA PRIVATE KEY-----\n", "\n".join(random_text(i, 64) for i in range(5))),
]
CLEAN = [
    "key = get_user_profile_from_database2(x)", "session: src/main/java/org/example/App.java", "the key differences between", "auth=authenticate_with_stored_hash", "keyboardLayoutManagerFactory", "cookie: session-expired-2024-01-01", "key Zusammenhangsanalyse was",
    "signature: function(arg1, arg2)", "monkey-patching123", "license key: see https://example.com/licenses/LICENSE-2.0", "key: readUserProfileCache", "conn = sqlite3.connect('example.db')", "secretary2019", "pass 1234567890 of 2024-11-11",
]


@pytest.fixture(scope="module")
def words(spark):
    return secret_scan.identifier_dictionary(spark.createDataFrame([(PROSE,)] * 3, "text string"))


def test_novel_strings_are_found_and_names_stay(spark, words):
    rows = [(i, f"{PROSE}{a}{b} and so on. {PROSE}") for i, (a, b) in enumerate(PLANTED)] + [(100 + i, f"{PROSE}{t} and so on. {PROSE}") for i, t in enumerate(CLEAN)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in secret_scan.find_secrets(df, dictionary=words).collect():
        if r["doc_id"] >= 100:
            assert not r["spans"]
        else:
            value = "".join(s["value"] for s in r["spans"] if s["kind"] == "novel")
            assert value.strip() and value.strip()[:12] in rows[r["doc_id"]][1] and PLANTED[r["doc_id"]][1][:12] in value
    left = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(df, dictionary=words).collect()}
    assert all(left[i] == t for i, t in rows if i >= 100) and all("<SECRET>" in left[i] for i in range(len(PLANTED)))
    assert secret_scan.redact_secrets(df.withColumnRenamed("doc_id", "redacted")).columns == ["redacted", "text"]


def test_compression_decides(words):
    novelty = secret_scan.Novelty(words)
    known, strange = "key: readUserProfileCacheManager", "key: rxadUqerPrzfileCbcheMwnagqr"
    assert secret_scan.candidates(known) and not secret_scan.novel_spans(known, [], novelty) and secret_scan.novel_spans(strange, [], novelty)
    twice = "key: x7Qp2Lw9Zk4Tn8Vb; confirmed key: x7Qp2Lw9Zk4Tn8Vb"
    assert [twice[a:z] for a, _, z, _ in secret_scan.novel_spans(twice, [], novelty)] == ["x7Qp2Lw9Zk4Tn8Vb"] * 2
    near = "Zk4Tn8VbX7Qp2Lw9 = load(); key: loadZk4Tn8VbX7Qp2Lw9"  # a part of the text around
    assert not secret_scan.novel_spans(near, [], novelty)


def test_words_in_order(spark):
    df = spark.createDataFrame([("alpha beta alpha gammaDelta beta Alpha the",), (None,), ("delta Gamma beta zeta",)], "text string")
    assert {r["word"]: r["n"] for r in secret_scan.word_counts(df).collect()} == {"alpha": 3, "beta": 3, "gamma": 2, "delta": 2, "zeta": 1}
    assert secret_scan.identifier_dictionary(df) == b"gamma delta beta alpha" and secret_scan.identifier_dictionary(df, most=16) == b"beta alpha"
