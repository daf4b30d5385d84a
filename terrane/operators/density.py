"""Density clusters of the points of each cell: mutual reachability, spanning tree, condensed tree, stability.

A point's core distance is the cosine distance to its k-th nearest other, and two points reach each other at the largest
of their distance and core distances.  The tree that spans a cell's points at least reach is cut from its longest edge
on: where both sides have ``least`` points they are clusters of their own, where one has, the others leave it, and the
cluster goes on.  A cluster's stability adds up, over its points, by how much 1 / reach grew from its birth until they
left it; clusters are chosen from the leaves up where they are more stable than all that were chosen inside them.  The
whole cell is never chosen: a lone cluster is noise, as is every point outside of the chosen ones.

A cell of up to ``block`` points is one task's.  Points of a larger one are dealt to shares that meet all points of the
cell: once for core distances, then in each of Boruvka's rounds for the first edge that leaves a component.  The tree
itself, an edge of 24 bytes a point, is then one task's: take cells in proportion to the points.  Equal vectors are one
point with a weight.  Edges of equal reach are taken by the ids of their ends, smaller first, so that the result doesn't
depend on how points were dealt.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.blocks import AT_ONCE, BLOCK, against, cosines, neighbours, share, shared, slack, units
from terrane.operators.graph import min_labels
from terrane.sources.tables import release, stored

LEAST = 5
#: Candidates of a point among those that pass at once, beyond which a better bound is looked for first.
LOOSE = 64
CELL = ["seed", "cx", "cy"]
_TINY = 1e-12


def core_distances(d: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Of a square matrix of distances: the distance within which a point has ``k`` others, its own copies among them, or
    the largest where there are fewer."""
    order = np.argpartition(d, k, axis=1)[:, : k + 1] if k + 1 < len(d) else np.arange(len(d))[None, :].repeat(len(d), axis=0)  # weights are 1 at least
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, axis=1), axis=1, kind="stable"), axis=1)
    near, seen = np.take_along_axis(d, order, axis=1), np.cumsum(weights[order], axis=1) - 1  # itself comes at 0
    enough = seen >= k
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), order.shape[1] - 1)
    return np.where(weights - 1 >= k, 0.0, near[np.arange(len(d)), at])


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, reach) of the least spanning tree of unit vectors, row numbers a < b; no matrix is held."""
    n = len(x)
    best, source, todo = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    out, at = [], 0
    for _ in range(n - 1):
        todo[at] = False
        reach = np.maximum(np.maximum(np.round(1 - x @ x[at], 12), core), core[at])
        low, high = np.minimum(np.arange(n), at), np.maximum(np.arange(n), at)
        old_low, old_high = np.minimum(np.arange(n), source), np.maximum(np.arange(n), source)
        tie = (reach == best) & ((low < old_low) | (low == old_low) & (high < old_high))
        closer = todo & ((reach < best) | tie)
        best[closer], source[closer] = reach[closer], at
        left = np.flatnonzero(todo)
        least = left[best[left] == best[left].min()]
        ends = np.stack([np.minimum(least, source[least]), np.maximum(least, source[least])])
        at = int(least[np.lexsort((ends[1], ends[0]))[0]])
        out.append((min(at, int(source[at])), max(at, int(source[at])), float(best[at])))
    a, b, w = zip(*out, strict=True) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w, np.float64)


def merges(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sides (n - 1, 2), reach, size): the dendrogram; nodes below n are points, node n + i is the i-th merge."""
    order = np.lexsort((b, a, w))
    root, top = np.arange(n), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sides, size = np.zeros((max(n - 1, 0), 2), np.int64), np.concatenate([weights, np.zeros(max(n - 1, 0), np.int64)])
    for i, e in enumerate(order.tolist()):
        p, q = find(int(a[e])), find(int(b[e]))
        sides[i] = top[p], top[q]
        size[n + i] = size[top[p]] + size[top[q]]
        root[q] = p
        top[p] = n + i
    return sides, w[order], size


def chosen_clusters(n: int, sides: np.ndarray, reach: np.ndarray, size: np.ndarray, core: np.ndarray, least: int) -> np.ndarray:
    """A number of its cluster for each point, -1 for noise."""
    if n < 2:
        return np.full(n, -1)
    rate = 1 / np.maximum(reach, _TINY)
    birth, parent, stability, left_at = [0.0], [-1], [0.0], np.full(n, -1)

    def leave(node: int, cluster: int) -> None:
        todo = [node]
        while todo:
            k = todo.pop()
            if k < n:
                left_at[k] = cluster
            else:
                todo += sides[k - n].tolist()

    todo = [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:  # copies of one vector
            stability[cluster] += float(size[node]) * (1 / max(float(core[node]), _TINY) - birth[cluster])
            left_at[node] = cluster
            continue
        now = float(rate[node - n])
        large = [k for k in sides[node - n].tolist() if size[k] >= least]
        if len(large) == 2:
            stability[cluster] += float(size[node]) * (now - birth[cluster])
            for k in large:
                birth.append(now)
                parent.append(cluster)
                stability.append(0.0)
                todo.append((k, len(birth) - 1))
            continue
        for k in sides[node - n].tolist():
            if k in large:
                todo.append((k, cluster))
            else:
                stability[cluster] += float(size[k]) * (now - birth[cluster])
                leave(k, cluster)
    best, chosen, inside = list(stability), [False] * len(birth), [0.0] * len(birth)
    for c in range(len(birth) - 1, 0, -1):  # a cluster's number is above its parent's
        chosen[c] = stability[c] >= inside[c]
        best[c] = max(stability[c], inside[c])
        inside[parent[c]] += best[c]
    final = [-1] * len(birth)
    for c in range(1, len(birth)):
        up = final[parent[c]]
        final[c] = up if up >= 0 else (c if chosen[c] else -1)
    return np.array(final)[left_at]


def _labelled(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, rep) of the points in clusters, a cluster being named by its smallest id."""
    kept = label >= 0
    ids, label = ids[kept], label[kept]
    least = np.full(label.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return least[label], ids


FOUND = "seed int, cx int, cy int, root bigint, rep bigint, error string"


def _rows(key, root: np.ndarray, rep: np.ndarray, error: str | None = None) -> pa.Table:
    n = 1 if error else len(rep)
    ids = [pa.array([None], pa.int64())] * 2 if error else [pa.array(root, pa.int64()), pa.array(rep, pa.int64())]
    return pa.table([*(pa.array([k.as_py()] * n, pa.int32()) for k in key[:3]), *ids, pa.array([error] * n, pa.string())], [*CELL, "root", "rep", "error"])


def isolated(key, label: Callable, *tables: pa.Table) -> pa.Table:
    """What a task returns; its failure is a row with the error's text."""
    try:
        return label(*tables)
    except Exception as e:  # noqa: BLE001  whatever a clusterer raises is its seed's outcome
        return _rows(key, np.zeros(0), np.zeros(0), f"{type(e).__name__}: {e}"[:400])


class Closest:
    """Of each component of held points the first edge, by (reach, smaller id, larger id), to another of the points that pass."""

    def __init__(self, held: pa.Table) -> None:
        self.key = {c: held[c][0] for c in CELL}
        self.ids, self.x, self.core = held["vec_id"].to_numpy(), units(held), held["core"].to_numpy()
        self.single = self.x.astype(np.float32)
        self.names, self.own = np.unique(held["comp"].to_numpy(), return_inverse=True)
        n = len(self.names)
        self.w, self.a, self.b, self.other = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def meet(self, rows: pa.RecordBatch) -> None:
        ids, y, core, comp = rows["vec_id"].to_numpy(), units(rows), rows["core"].to_numpy(), rows["comp"].to_numpy()
        single, off = y.astype(np.float32), 2 * slack(y.shape[1])
        for s in range(0, len(self.x), AT_ONCE):
            own, mine = self.own[s : s + AT_ONCE], self.core[s : s + AT_ONCE]
            c, most = self.single[s : s + AT_ONCE] @ single.T, self.w[own]
            within = lambda most: c >= np.where(mine <= most, 1 - most - off, np.inf).astype(np.float32)[:, None]  # noqa: B023, E731
            near = within(most)
            for many in (AT_ONCE, len(y)):  # few points give a bound, which most of the others are beyond
                loose = np.flatnonzero(np.count_nonzero(near, axis=1) > LOOSE)
                if len(loose):
                    reach = np.maximum(np.maximum(1 - c[loose, :many], core[None, :many].astype(np.float32)), mine[loose, None].astype(np.float32))
                    reach[(self.names[own[loose], None] == comp[None, :many]) | np.isnan(reach)] = np.inf
                    least = self.w.copy()
                    np.minimum.at(least, own[loose], reach.min(axis=1).astype(np.float64) + off)
                    most = np.minimum(most, least[own])
                    near = within(most)
            a, b = np.divmod(np.flatnonzero(near.ravel()), len(y))
            fit = (self.names[own[a]] != comp[b]) & (core[b] <= most[a])
            a, b = a[fit], b[fit]
            if not len(a):
                continue
            w = np.maximum(np.maximum(np.round(1 - cosines(self.x, s + a, y, b), 12), mine[a]), core[b])
            p, q = self.ids[s + a], ids[b]
            at, lo, hi, other = own[a], np.minimum(p, q), np.maximum(p, q), comp[b]
            had = np.flatnonzero(np.isfinite(self.w))
            had = had[np.isin(had, at)]
            at, w, lo, hi, other = (np.concatenate(x) for x in ((had, at), (self.w[had], w), (self.a[had], lo), (self.b[had], hi), (self.other[had], other)))
            order = np.lexsort((hi, lo, w, at))
            first = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
            for name, v in (("w", w), ("a", lo), ("b", hi), ("other", other)):
                getattr(self, name)[at[first]] = v[first]

    def out(self):
        there = np.isfinite(self.w)
        n = int(there.sum())
        columns = [pa.array(v[there], t) for v, t in ((self.names, pa.int64()), (self.w, pa.float64()), (self.a, pa.int64()), (self.b, pa.int64()), (self.other, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(pa.array([v.as_py()] * n, pa.int32()) for v in self.key.values()), *columns], [*CELL, "comp", "w", "a", "b", "other"])


def spanning_trees(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cell, a, b, w): the least spanning tree of the reaches of a cell's points (cell, vec_id, x, core), with a < b.

    In a round of Boruvka every component but the cell's largest takes its first edge by (w, a, b), which shares of its
    points look for among all points of the cell; components at least halve, and every round is stored.
    """
    state = stored(points.select(*CELL, "vec_id", "x", "core", F.col("vec_id").alias("comp")))
    trees = []
    while True:
        counts = stored(state.groupBy(*CELL, "comp").agg(F.count("*").alias("n")))
        most = counts.groupBy(*CELL).agg(F.max(F.struct("n", "comp"))["comp"].alias("most"), F.count("*").alias("comps")).where("comps > 1").select(*CELL, "most")
        most = stored(most)
        rest = counts.join(F.broadcast(most), CELL).where("comp <> most").agg(F.sum("n")).first()[0]
        release(counts)
        if not rest:
            break
        every = state.join(F.broadcast(most), CELL)  # a row a cell
        left, right, tasks = shared(every.where("comp <> most").drop("most"), every.drop("most"), CELL, share(rest, block))
        found = against(left, right, [*CELL, "part"], Closest, "seed int, cx int, cy int, comp bigint, w double, a bigint, b bigint, other bigint", min(2 * tasks, 1024))
        best = stored(found.groupBy(*CELL, "comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select(*CELL, "comp", "e.*"))
        if best.isEmpty():  # what is left has no distance to others
            break
        trees.append(best)
        labels = min_labels(best.select(*CELL, F.col("comp").alias("src"), F.col("other").alias("dst")), tuple(CELL))
        moved = state.join(labels.select(*CELL, F.col("node").alias("comp"), "component").hint("merge"), [*CELL, "comp"], "left")
        new = stored(moved.select(*CELL, "vec_id", "x", "core", F.coalesce("component", "comp").alias("comp")))
        release(state, labels, most)
        state = new
    release(state, most)
    out = state.limit(0).select(*CELL, F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.col("core").alias("w")) if not trees else None
    for t in trees:
        rows = t.select(*CELL, "a", "b", "w")
        out = rows if out is None else out.union(rows)
    return out.distinct()


def condensed(seed: int, x: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
    """Each point's cluster, -1 for noise, of unit vectors with weights."""
    d = np.round(1 - x @ x.T, 12)
    np.fill_diagonal(d, -1.0)  # first in any order
    core = np.maximum(core_distances(d, weights, least), 0.0)
    return chosen_clusters(len(x), *merges(len(x), *spanning_tree(x, core), weights), core, least)


def clusters_or_errors(members: DataFrame, vectors: DataFrame, least: int = LEAST, block: int = BLOCK, label: Callable = condensed) -> DataFrame:
    """(seed, node, vec_id, error): clusters of each cell of ``members`` (seed, cx, cy, vec_id); nodes are named by their cell
    and smallest member.  A cell that fails is a row with its seed and error.  Null vectors lie in no cluster.

    ``label`` (seed, unit vectors, weights, least) may replace the clusterer of cells of up to ``block`` points.
    """
    own = vectors.where("embedding is not null").select("vec_id", F.xxhash64("embedding").alias("h"), F.col("embedding").alias("x"))
    reps = stored(own.groupBy("h", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    owner = stored(own.join(reps, ["h", "x"]).select("vec_id", "rep"))
    points = stored(members.select(*CELL, F.col("vec_id").alias("rep")).join(reps.select("rep", "x", "weight"), "rep").withColumnRenamed("rep", "vec_id"))
    sizes = stored(points.groupBy(*CELL).agg(F.count("*").alias("n")))

    def whole(key, rows):
        def one(rows):
            rows = rows.take(pa.array(np.argsort(rows["vec_id"].to_numpy())))
            return _rows(key, *_labelled(rows["vec_id"].to_numpy(), label(key[0].as_py(), units(rows), rows["weight"].to_numpy(), least)))

        return isolated(key, one, rows)

    found = points.join(sizes.where(F.col("n") <= block), CELL).select(*CELL, "vec_id", "x", "weight").groupBy(*CELL).applyInArrow(whole, FOUND)
    large = sizes.where(F.col("n") > block)
    if not large.isEmpty():
        found = found.union(_large_cells(points.join(large, CELL), least, block))
    found = stored(found)
    release(points, sizes, reps)
    return found.join(owner, "rep", "left").select("seed", F.when(F.col("error").isNull(), F.concat_ws("-", "cx", "cy", "root")).alias("node"), "vec_id", "error")


def or_raise(found: DataFrame) -> DataFrame:
    """(seed, node, vec_id) of ``found`` (seed, node, vec_id, error); an error fails the query."""
    return found.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))).select("seed", "node", "vec_id")


def clusters(members: DataFrame, vectors: DataFrame, least: int = LEAST, block: int = BLOCK, label: Callable = condensed) -> DataFrame:
    """(seed, node, vec_id): as ``clusters_or_errors``, an error failing the query."""
    return or_raise(clusters_or_errors(members, vectors, least, block, label))


def _large_cells(points: DataFrame, least: int, block: int) -> DataFrame:
    near = neighbours(points.select(*CELL, "vec_id", "x", "weight"), least, block, tuple(CELL))
    nearest = near.groupBy(*CELL, "vec_id").agg(F.sort_array(F.collect_list(F.struct("d", "weight"))).alias("near"))  # ``least`` each
    reached = F.aggregate("near", F.struct((F.col("weight") - 1).alias("seen"), F.lit(0.0).alias("d")), lambda s, p: F.when(s["seen"] >= least, s).otherwise(F.struct((s["seen"] + p["weight"]).alias("seen"), p["d"].alias("d"))))
    ready = stored(points.join(nearest, [*CELL, "vec_id"]).withColumn("core", F.greatest(reached["d"], F.lit(0.0))).select(*CELL, "vec_id", "x", "weight", "core", "n"))

    forest = spanning_trees(ready, block)

    def label(key, edge, rows):
        rows = rows.take(pa.array(np.argsort(rows["vec_id"].to_numpy())))
        ids, weights = rows["vec_id"].to_numpy(), rows["weight"].to_numpy()
        a, b = (np.searchsorted(ids, edge[c].to_numpy()) for c in ("a", "b"))
        found = merges(len(ids), a, b, edge["w"].to_numpy(), weights)
        return _rows(key, *_labelled(ids, chosen_clusters(len(ids), *found, rows["core"].to_numpy(), least)))

    def task(key, edge, rows):
        return isolated(key, lambda *tables: label(key, *tables), edge, rows)

    return forest.groupBy(*CELL).cogroup(ready.select(*CELL, "vec_id", "weight", "core").groupBy(*CELL)).applyInArrow(task, FOUND)
