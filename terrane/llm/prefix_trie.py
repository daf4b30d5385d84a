"""The trie of all prefixes of conversations, built by z-fast tries.

A turn is a digest of its role and text, a prefix a polynomial of its turns' digests (four primes below 2^31) and its
depth: 24 bytes, equal for equal sequences of turns.  Tasks put their conversations into z-fast tries in batches.  Such a
trie keeps compacted nodes in a table by their handle, the prefix at the two-fattest depth of the node's edge; a
conversation's exit node is found by fat binary search, with as many lookups as its length has bits.  When a batch is in,
edges are expanded: each depth of an edge is a node, whose figures come from sums that went up the compacted trie once.
A task so hands on each of its prefixes once, whatever number of its conversations share it, and Spark adds up prefixes
of the same bytes.

Sums over a node's subtree come from members alone: a node counts for its smallest member, and a member that is the
smallest of a node is the smallest of all deeper nodes on its way as well.  So each conversation knows a depth from which
on its nodes count for it, and a second pass over one conversation of each sequence adds up, for every prefix, what
counts below it.

Turns are dealt by ranges of (conversation, order), so that a conversation of any length is cut into pieces of bounded
size.  Only as many conversations are cut as there are ranges; figures of their pieces go through the driver, no turns.

Defined results: turns are ordered by turn (null first), then role, then the text's digest; a null role or text is empty;
repeated turns are turns; rows without a conversation id are left out; no rows give no nodes, not even a root; sums
beyond a long are not expected; other columns are left out, whatever their names.  A conversation of which nothing is
left is a member of the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import release, stored

#: Primes below 2^31 and the bases of the four polynomials; bytes of a prefix; prefixes that a task's trie holds.
MODULI = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.int64)
BASES = np.array([1766319049, 1518500249, 1859775393, 1899447441], np.int64)
RECORD, HELD = 24, 1 << 20
#: How conversations share their beginnings: by groups of so many ids, and fewer turns than this.
GROUP, SHARED = 5, 9


# --- prefixes ----------------------------------------------------------------------------------------------------------


def powers(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(sum of lengths, 4): the bases to the powers start, start + 1, ... of each row."""
    most = int(length.max(initial=0))
    table = np.ones((max(most, 1), 4), np.int64)
    for k in range(1, most):
        table[k] = table[k - 1] * BASES % MODULI
    first = np.array([[pow(int(b), int(s), int(m)) for b, m in zip(BASES, MODULI, strict=True)] for s in start], np.int64).reshape(-1, 4)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return table[step] * np.repeat(first, length, axis=0) % MODULI


def prefixes(digests: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    """Per row the records of its prefixes at depths start, ..., start + length, as if nothing came before ``start``.

    ``digests`` (sum of lengths, 4) are the turns' digests as 32-bit words."""
    terms = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(digests.astype(np.int64) % MODULI * powers(start, length) % MODULI, axis=0)])
    ends = np.cumsum(length)
    rows = np.repeat(np.arange(len(length)), length + 1)
    at = np.arange(len(rows)) - rows  # place among the turns: one record more a row
    out = np.empty((len(rows), RECORD // 4), np.uint32)
    out[:, :4] = (terms[at] - terms[(ends - length)[rows]]) % MODULI
    depth = at - (ends - length)[rows] + start[rows]
    out[:, 4:] = depth.astype("<i8").view(np.uint32).reshape(-1, 2)
    data, cuts = out.tobytes(), np.concatenate([[0], np.cumsum((length + 1) * RECORD)]).tolist()
    return [data[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]


def shifted(path: bytes, anchor: np.ndarray) -> bytes:
    """The records of a piece with the polynomial of all that comes before it added."""
    out = np.frombuffer(path, np.uint32).reshape(-1, RECORD // 4).copy()
    out[:, :4] = (out[:, :4].astype(np.int64) + anchor) % MODULI
    return out.tobytes()


# --- a task's trie -----------------------------------------------------------------------------------------------------


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that can be divided by two most often."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Node:
    """A compacted node: its edge covers depths (top, end] of ``path``, which starts at depth ``start``."""

    __slots__ = ("after", "children", "count", "end", "least", "low", "parent", "path", "sizes", "start", "top")

    def __init__(self, parent: Node | None, start: int, top: int, end: int, path: bytes, sizes: np.ndarray):
        self.parent, self.start, self.top, self.end, self.path, self.sizes = parent, start, top, end, path, sizes
        self.children: dict[bytes, Node] = {}
        self.count, self.after, self.least, self.low = 0, 0, None, None  # of what ends here

    def record(self, depth: int) -> bytes:
        at = (depth - self.start) * RECORD
        return self.path[at : at + RECORD]

    @property
    def handle(self) -> bytes:
        return self.record(fattest(self.top, self.end))


class ZFastTrie:
    """Conversations below roots (several, where pieces start at different prefixes), each with its own table of handles."""

    def __init__(self):
        self.roots: dict[bytes, tuple[Node, dict[bytes, Node]]] = {}
        self.held = 0

    def exit_node(self, root: Node, handles: dict[bytes, Node], key: Node) -> Node:
        """The deepest node whose edge shares a prefix with the key, by fat binary search."""
        a, b, at = root.end, key.end, root
        while a < b:
            f = fattest(a, b)
            found = handles.get(key.record(f))
            if found is None:
                b = f - 1
            elif found.end <= key.end and found.record(found.end) == key.record(found.end):
                a, at = found.end, found
            else:
                return found
        return at.children.get(key.record(at.end + 1), at) if at.end < key.end else at

    def insert(self, start: int, path: bytes, sizes: np.ndarray) -> Node:
        """The node at which a path ends; it is made, and edges are split, where they aren't there yet."""
        key = Node(None, start, start, start + len(path) // RECORD - 1, path, sizes)
        if path[:RECORD] not in self.roots:
            self.roots[path[:RECORD]] = Node(None, start, start, start, path[:RECORD], sizes[:0]), {}
        root, handles = self.roots[path[:RECORD]]
        at = self.exit_node(root, handles, key)
        low, high = at.top, min(at.end, key.end)
        while low < high:  # the deepest prefix in common
            mid = (low + high + 1) // 2
            low, high = (mid, high) if at.record(mid) == key.record(mid) else (low, mid - 1)
        if low < at.end:
            at = self.split(handles, at, low)
        if key.end > at.end:
            key.parent, key.top = at, at.end
            at.children[key.record(at.end + 1)] = handles[key.handle] = key
            self.held += key.end - key.start
            at = key
        return at

    def split(self, handles: dict[bytes, Node], node: Node, depth: int) -> Node:
        upper = Node(node.parent, node.start, node.top, depth, node.path, node.sizes)
        del handles[node.handle]
        node.parent.children[node.record(node.top + 1)] = upper
        node.parent, node.top = upper, depth
        upper.children[node.record(depth + 1)] = node
        handles[upper.handle], handles[node.handle] = upper, node
        return upper

    def add(self, start: int, path: bytes, sizes: np.ndarray, conv: int, count: int = 1, after: int = 0, low: int | None = None) -> None:
        """A member: ``count`` for it, ``after`` for what comes behind the path, ``low`` the depth from which on nodes count
        for it (None: all bytes count)."""
        if low is not None and start < low - 1 < start + len(sizes):
            self.insert(start, path[: (low - start) * RECORD], sizes)  # so that an edge counts as a whole or not at all
        node = self.insert(start, path, sizes)
        node.count, node.after = node.count + count, node.after + after
        node.least = conv if node.least is None else min(node.least, conv)
        if low is not None:
            node.low = low if node.low is None else min(node.low, low)

    def expanded(self):
        """Batches (node, parent, depth, count, conv_id, size, after, low) of all prefixes; ``after`` adds up the bytes of
        the prefix's last turn and all that follow, of members for which they count."""
        rows: list[tuple] = []
        for root, _ in self.roots.values():
            order, todo = [], [root]
            while todo:
                order.append(node := todo.pop())
                todo += node.children.values()
            for node in reversed(order):  # children first
                if node.least is None:
                    continue
                sizes = node.sizes[node.top - node.start : node.end - node.start]
                times = node.count if node.low is None else int(node.low <= node.top + 1)
                after = node.after + times * np.cumsum(sizes[::-1])[::-1]
                for k, d in enumerate(range(node.top + 1, node.end + 1)):
                    rows.append((node.record(d), node.record(d - 1), d, node.count, node.least, int(sizes[k]), int(after[k]), node.low))
                up = node.parent
                if up is None:
                    if node.start == 0:
                        rows.append((node.path, None, 0, node.count, node.least, 0, node.after, node.low))
                else:
                    up.count, up.after = up.count + node.count, up.after + int(after[0])
                    up.least = node.least if up.least is None else min(up.least, node.least)
                    if node.low is not None:
                        up.low = node.low if up.low is None else min(up.low, node.low)
                if len(rows) > 1 << 14:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


NODE = {"node": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "count": pa.int64(), "conv_id": pa.int64(), "size": pa.int64(), "after": pa.int64(), "low": pa.int64()}
NODE_SQL = "node binary, parent binary, depth bigint, count bigint, conv_id bigint, size bigint, after bigint, low bigint"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(NODE), NODE.values(), strict=True)], list(NODE))


# --- conversations as pieces -------------------------------------------------------------------------------------------


def pieces_of_turns(df: DataFrame) -> DataFrame:
    """(conv_id, part, start, n_turns, digests, sizes, cut): conversations' turns in order, in pieces by range; ``cut`` is
    whether a conversation has more than one."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    dealt = turns.repartitionByRange("conv_id", "turn", "role", "digest").withColumn("part", F.spark_partition_id())
    own = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "size")))  # a range's share at most
    packed = stored(dealt.groupBy("conv_id", "part").agg(own.alias("t")).select("conv_id", "part", F.col("t.digest").alias("digests"), F.col("t.size").alias("sizes")))
    lengths = packed.groupBy("conv_id").agg(F.count("*").alias("parts"), F.sum(F.size("digests")).alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", F.size("digests").alias("n")))).alias("all_parts"))
    cut = F.broadcast(lengths.where("parts > 1").select("conv_id", "n_turns", "all_parts"))  # at most one a boundary of ranges
    before = F.aggregate(F.filter("all_parts", lambda p: p["part"] < F.col("part")), F.lit(0), lambda s, p: s + p["n"])
    out = packed.join(cut, "conv_id", "left").select("conv_id", "part", F.coalesce(before, F.lit(0)).cast("long").alias("start"), F.coalesce("n_turns", F.size("digests")).cast("long").alias("n_turns"), "digests", "sizes", F.col("n_turns").isNotNull().alias("cut"))
    out.stored_path = packed.stored_path
    return out


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(pieces: DataFrame, share: bool = True) -> DataFrame:
    """(conv_id, start, path, sizes, cut, part): pieces of conversations whose first turns are those of their group's first
    one, if they ``share`` them."""
    first = F.sort_array(F.collect_list(F.struct("start", F.slice("digests", 1, SHARED).alias("d"), F.slice("sizes", 1, SHARED).alias("s"))))
    some = lambda c: F.slice(F.flatten(F.col(c)), 1, SHARED - 1)
    heads = pieces.where((F.col("conv_id") % GROUP == 0) & (F.col("start") < SHARED)).groupBy(F.col("conv_id").alias("base")).agg(first.alias("h")).select("base", some("h.d").alias("head"), some("h.s").alias("head_sizes"))
    own = pieces.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    h = F.when(F.lit(not share) | (F.col("base") == F.col("conv_id")), 0).otherwise(shared_turns(F.col("conv_id"))).cast("int")
    joined = own.withColumn("h", h).join(heads, "base", "left").withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    skip = F.greatest(F.col("h") - F.col("start"), F.lit(0)).cast("int")

    def turns(c: str, head: str) -> Column:
        none = F.array().cast(joined.schema[c].dataType)
        taken = F.when(F.col("start") == 0, F.slice(F.coalesce(head, none), F.lit(1), F.col("k"))).otherwise(none)
        return F.concat(taken, F.slice(c, skip + 1, F.greatest(F.size(c), F.lit(1))))

    # a later piece starts behind the turns taken and those kept before it
    start = F.when(F.col("start") == 0, 0).otherwise(F.col("k") + F.greatest(F.col("start"), F.col("h")) - F.col("h")).cast("long")
    rows = joined.select("conv_id", start.alias("start"), turns("digests", "head").alias("digests"), turns("sizes", "head_sizes").alias("sizes"), "cut", "part")

    def run(batches):
        for b in batches:
            step = max(1, int(b.num_rows * (1 << 18) / max(1, len(b.column(2).values))))
            for a in range(0, b.num_rows, step):
                s = b.slice(a, step)
                length = np.diff(s.column(2).offsets.to_numpy())
                digests = np.frombuffer(b"".join(s.column(2).flatten().to_pylist()), "<u4").reshape(-1, 4)
                paths = prefixes(digests, s.column(1).to_numpy(), length.astype(np.int64))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(paths, pa.binary()), s.column(3), s.column(4), s.column(5)], ["conv_id", "start", "path", "sizes", "cut", "part"])

    return rows.mapInArrow(run, "conv_id bigint, start bigint, path binary, sizes array<bigint>, cut boolean, part int")


def cut_pieces(pieces: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, int, bool]]:
    """By (conv_id, part) of cut conversations' pieces, those without turns left out: the polynomial before it, the bytes
    behind it, and whether it is the last.  As many rows as ranges, twice at most."""
    whole = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, v: s + v)
    by_conv: dict[int, list] = {}
    for r in pieces.where("cut").select("conv_id", "part", F.size("sizes").alias("n"), whole.alias("bytes"), F.expr(f"substring(path, -{RECORD}, 16)").alias("last")).orderBy("conv_id", "part").collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    out: dict[tuple[int, int], tuple[np.ndarray, int, bool]] = {}
    for conv, every in by_conv.items():
        own = [r for r in every if r["n"]] or every[:1]
        anchor, behind = np.zeros(4, np.int64), sum(r["bytes"] for r in own)
        for r in own:
            behind -= r["bytes"]
            out[conv, r["part"]] = anchor, behind, r is own[-1]
            anchor = (anchor + np.frombuffer(bytes(r["last"]), "<u4").astype(np.int64)) % MODULI
    return out


def placed(pieces: DataFrame) -> DataFrame:
    """(conv_id, start, path, sizes, behind, last): whole prefixes, the bytes behind a piece, and whether it is the last."""
    known = cut_pieces(pieces)

    def run(batches):
        for b in batches:
            conv, paths, cut, part = (b.column(k).to_pylist() for k in (0, 2, 4, 5))
            found = [known.get((conv[k], part[k])) if c else (None, 0, True) for k, c in enumerate(cut)]
            keep = [k for k, f in enumerate(found) if f]
            rows = b.take(pa.array(keep, pa.int64()))
            new = [paths[k] if found[k][0] is None else shifted(paths[k], found[k][0]) for k in keep]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(new, pa.binary()), rows.column(3), pa.array([found[k][1] for k in keep], pa.int64()), pa.array([found[k][2] for k in keep], pa.bool_())], ["conv_id", "start", "path", "sizes", "behind", "last"])

    return pieces.mapInArrow(run, "conv_id bigint, start bigint, path binary, sizes array<bigint>, behind bigint, last boolean")


def tried(rows: DataFrame, member: Callable) -> DataFrame:
    """The prefixes of ``rows`` (conv_id, start, path, sizes, ...), each task's by z-fast tries; ``member`` gives, from a
    batch, each row's count, bytes behind it and depth from which on its nodes count."""

    def run(batches):
        trie = ZFastTrie()
        for b in batches:
            sizes, starts = b.column(3), b.column(1).to_pylist()
            flat, cuts = sizes.values.to_numpy(zero_copy_only=False), sizes.offsets.to_numpy()
            for k, (conv, path, more) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), member(b), strict=True)):
                trie.add(starts[k], path, flat[cuts[k] : cuts[k + 1]], conv, *more)
                if trie.held > HELD:
                    yield from trie.expanded()
                    trie = ZFastTrie()
        yield from trie.expanded()

    return rows.mapInArrow(run, NODE_SQL)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of the decimal ids in ascending order, joined by commas.

    Ids are joined in sorted ranges, and the ranges' texts digested one after the other, so that no group is held.
    """

    def texts(batches):
        for b in batches:
            nodes, ids = (c.to_pylist() for c in b.columns)
            cuts = [k for k in range(len(nodes)) if not k or nodes[k] != nodes[k - 1]]
            joined = [",".join(map(str, ids[a:z])) for a, z in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            rows = b.take(pa.array(cuts, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(joined, pa.string())], ["node", "id", "text"])

    def digests(batches):
        node, sha = None, hashlib.sha256()
        for b in batches:
            out = []
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "ends_sha256"])

    joined = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(texts, "node binary, id bigint, text string")
    return joined.repartition("node").sortWithinPartitions("node", "id").select("node", "text").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_nodes(df: DataFrame, share: bool = True) -> DataFrame:
    """One row a prefix of the conversations (conv_id, turn, role, text): (node, parent, conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256).  Unless they ``share`` them, conversations keep their own
    first turns."""
    turns = pieces_of_turns(df)
    pieces = stored(rebuilt(turns, share))
    release(turns)
    rows = stored(placed(pieces))
    release(pieces)

    def members(b):
        return [(1, behind, None) for behind in b.column(4).to_pylist()]

    found = tried(rows.select("conv_id", "start", "path", "sizes", "behind"), members)
    nodes = stored(found.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("count").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("after").alias("all_bytes")))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    with_children = stored(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    release(nodes)
    carriers = with_children.groupBy("conv_id").agg(F.min("depth").alias("low"), F.max_by((F.col("n_children") == 0).cast("long"), "depth").alias("leaf"))
    carried = stored(rows.join(carriers, "conv_id"))  # one conversation of each sequence
    behind = carried_behind(carried)

    def smallest(b):
        return [(leaf, behind.get((conv, start), 0), low) for conv, start, low, leaf in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 5)), strict=True)]

    below = tried(carried.select("conv_id", "start", "path", "sizes", "low", "leaf"), smallest).groupBy("node").agg(F.sum("count").alias("n_leaves"), F.sum("after").alias("own_bytes"), F.min("low").alias("low"))
    whole = stored(with_children.join(below, "node"))
    release(with_children, carried)
    # from the depth on at which nodes count for a conversation, parents are its own as well
    up = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("up_conv"))
    up = whole.where("low = depth and depth > 0").select("node", "parent").join(up, "parent").select("node", "up_conv")
    ends = end_digests(rows.where("last").select(F.expr(f"substring(path, -{RECORD}, {RECORD})").alias("node"), "conv_id"))
    parent = F.when(F.col("depth") > 0, F.coalesce("up_conv", "conv_id")).alias("parent_conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.join(up, "node", "left").join(ends, "node", "left").select("node", "parent", "conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", (F.col("all_bytes") - F.col("own_bytes")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def carried_behind(carried: DataFrame) -> dict[tuple[int, int], int]:
    """By (conv_id, start) of pieces of cut conversations: the bytes behind them that count for the conversation."""
    cut = F.col("start") > 0
    convs = carried.where(cut | (~F.col("last")))
    own = F.aggregate(F.filter(F.transform("sizes", lambda v, i: F.when(F.col("start") + i + 1 >= F.col("low"), v).otherwise(0)), lambda v: v > 0), F.lit(0).cast("long"), lambda s, v: s + v)
    out: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for r in convs.select("conv_id", "start", own.alias("own")).orderBy("conv_id", F.desc("start")).collect():  # twice the ranges at most
        out[r["conv_id"], r["start"]] = total.get(r["conv_id"], 0)
        total[r["conv_id"]] = total.get(r["conv_id"], 0) + r["own"]
    return out


def trie_digest(df: DataFrame) -> DataFrame:
    return prefix_nodes(df).drop("node", "parent")
