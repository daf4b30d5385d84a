"""The prefix trie against a plain version in Python, for cut conversations, copies, ties and nulls."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from terrane.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, share=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9 if share else 0
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    ends = {node: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node)) for node, m in members.items()}
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items())


def got(df, **options):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.prefix_nodes(df, **options).select(*COLUMNS).collect())


def some_rows(seed, convs, most, letters):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), "é" * rng.randrange(3) + rng.choice(letters)) for c in range(convs) for t in range(rng.randrange(1, most))]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(-1 if v is None else v for v in r) for r in queries.queries()["op11_prefix_trie"](spark, SF).select(*COLUMNS).collect()) == plain(rows)


def test_shared_beginnings_nulls_ties_and_copies(spark):
    rows = some_rows(1, 60, 14, "ab") + [(200 + i, t, "user", "same") for i in range(25) for t in range(3)]
    rows += [(300, None, None, None), (300, None, None, None), (300, 1, "user", "x"), (300, 1, "user", "w"), (None, 1, "user", "x"), (6, 99, None, ""), (1001, 0, "u", "only")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA + ", node string, depth int")
    assert got(df) == plain(rows)
    assert got(df, share=False) == plain(rows, share=False)


@pytest.mark.parametrize("seed", [2, 3])
def test_conversations_cut_into_pieces(spark, seed):
    rows = some_rows(seed, 12, 60, "a") + [(c, t, "user", str(t // 40)) for c in (40, 41, 42) for t in range(700)] + [(90 + c, t, "user", "b") for c in range(7) for t in range(7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        pieces = prefix_trie.pieces_of_turns(df)
        assert pieces.where("cut").count() > 20
        assert got(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_empty_tables(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_tries_of_a_task():
    rng = random.Random(5)
    trie, plain_members = prefix_trie.ZFastTrie(), defaultdict(set)
    for c in range(300):
        turns = [rng.choice("ab") for _ in range(rng.randrange(20))]
        path = b"".join(hashlib.sha256("".join(turns[:d]).encode()).digest()[:24] for d in range(len(turns) + 1))
        trie.add(0, path, prefix_trie.np.ones(len(turns), int), c)
        for d in range(len(turns) + 1):
            plain_members[path[d * 24 : d * 24 + 24]].add(c)
    rows = [r for b in trie.expanded() for r in b.to_pylist()]
    assert {r["node"]: (r["count"], r["conv_id"]) for r in rows} == {n: (len(m), min(m)) for n, m in plain_members.items()} and len(rows) == len(plain_members)
    ((_, handles),) = trie.roots.values()
    assert len(handles) < 600 and all(n.handle == k for k, n in handles.items())
    assert [prefix_trie.fattest(a, b) for a, b in ((0, 5), (4, 7), (5, 6), (8, 13), (0, 1))] == [4, 6, 6, 12, 1]


def test_hot_tries_are_handed_on(spark, monkeypatch):
    rows = some_rows(6, 40, 10, "ab")
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    monkeypatch.setattr(prefix_trie, "HELD", 5)
    assert got(df.withColumn("text", F.col("text"))) == plain(rows)
