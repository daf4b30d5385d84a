"""Lens, overlapping cover, clusters in cells, and the graph of clusters that share members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.vectors import as_doubles, dot, hash_rank
from terrane.operators.blocks import AT_ONCE, against, cosines, linked, share, shared, slack, units
from terrane.operators.graph import min_labels
from terrane.sources.tables import release, stored

CELLS, OVERLAP, RADIUS, LEAST = 15, 0.3, 0.72, 3
#: Seeds of the bootstrap, points of a cell that one task compares with each other, and which share of as many visits all
#: blocks of the cell.
SEEDS, BLOCK, VISITORS = 25, 2048, 8
#: Points of a task that compares blocks, about, and the most tasks.
TASK_POINTS, MOST_TASKS = 20_000, 1024


def seeds(spark, first: int = 42, many: int = SEEDS) -> DataFrame:
    return spark.range(first, first + many).select(F.col("id").cast("int").alias("seed"))


def lens(vectors: DataFrame, by_seed: DataFrame) -> DataFrame:
    """(seed, vec_id, u, v): two projections with signs by hash.

    The signs of a seed are two arrays as long as the longest vector; seeds are few rows, so their broadcast is bounded,
    and a projection is a product of arrays, without a shuffle.
    """
    whole = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d"))
    sign = lambda axis: F.transform(F.sequence(F.lit(0), F.greatest(F.col("d") - 1, F.lit(0))), lambda p: F.when(F.substring(hash_rank(axis, F.col("seed"), p), 1, 1) < "8", 1.0).otherwise(-1.0))
    signs = by_seed.crossJoin(F.broadcast(whole)).select("seed", sign(1).alias("s1"), sign(2).alias("s2"))
    rows = vectors.select("vec_id", as_doubles(F.col("embedding")).alias("x")).where(F.size("x") > 0).crossJoin(F.broadcast(signs))
    along = lambda s: dot(F.col("x"), F.slice(s, F.lit(1), F.size("x")))
    return rows.select("seed", "vec_id", along("s1").alias("u"), along("s2").alias("v"))


def cover(points: DataFrame, cells: int = CELLS, overlap: float = OVERLAP) -> DataFrame:
    """(seed, vec_id, cx, cy): the cells a point lies in.

    An axis has ``cells`` equal intervals between its least and largest value, each widened on both sides by half
    ``overlap`` of its width.
    """
    points = stored(points)
    ends = points.groupBy("seed").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    rows = points.join(F.broadcast(ends), "seed")

    def bins(c):
        t = (F.col(c) - F.col(f"{c}0")) / F.when(F.col(f"{c}1") > F.col(f"{c}0"), (F.col(f"{c}1") - F.col(f"{c}0")) / cells).otherwise(1.0)
        return F.sequence(F.greatest(F.lit(0), F.floor(t - overlap / 2).cast("int")), F.least(F.lit(cells - 1), F.floor(t + overlap / 2).cast("int")))

    rows = rows.withColumn("xs", bins("u")).withColumn("ys", bins("v"))
    rows = rows.select("seed", "vec_id", "ys", F.explode(F.when(F.size("xs") > 0, F.col("xs")).otherwise(F.array(F.lit(cells - 1)))).alias("cx"))
    return rows.select("seed", "vec_id", "cx", F.explode(F.when(F.size("ys") > 0, F.col("ys")).otherwise(F.array(F.lit(cells - 1)))).alias("cy"))


class Joined:
    """Which labels of held points and of points that pass have a link: a union of labels."""

    def __init__(self, held: pa.Table, least: float) -> None:
        self.key = {c: held[c][0] for c in ("seed", "cx", "cy")}
        self.least, self.up = least, {}
        self.x, self.label = units(held), held["label"].to_numpy()
        self.single = self.x.astype(np.float32)

    def find(self, i: int) -> int:
        up = self.up
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    def meet(self, rows: pa.RecordBatch) -> None:
        y, label = units(rows), rows["label"].to_numpy()
        single, off = y.astype(np.float32), slack(y.shape[1])
        roots = lambda c: np.array([self.find(int(i)) for i in c[0]], np.int64)[c[1]]
        theirs = roots(np.unique(label, return_inverse=True))
        for s in range(0, len(self.x), AT_ONCE):
            d = self.single[s : s + AT_ONCE] @ single.T
            a, b = np.divmod(np.flatnonzero((d >= np.float32(self.least - off)).ravel()), len(y))
            mine = roots(np.unique(self.label[s : s + AT_ONCE], return_inverse=True))
            other = mine[a] != theirs[b]
            a, b = a[other], b[other]
            sure = d[a, b] > self.least + off
            sure[~sure] = cosines(self.x, s + a[~sure], y, b[~sure]) >= self.least
            for p, q in np.unique(np.stack([mine[a[sure]], theirs[b[sure]]]), axis=1).T.tolist():
                p, q = self.find(p), self.find(q)
                if p != q:
                    self.up[max(p, q)] = min(p, q)

    def out(self):
        src = list(self.up)
        if src:
            n = len(src)
            yield pa.RecordBatch.from_arrays([*(pa.array([v.as_py()] * n, pa.int32()) for v in self.key.values()), pa.array(src, pa.int64()), pa.array([self.find(i) for i in src], pa.int64())], [*self.key, "src", "dst"])


def _linked_labels(points: DataFrame, cell: list[str], least: float) -> DataFrame | None:
    """(cell, src, dst): labels of ``points`` (cell, vec_id, x, label) that have a link; None where every cell has one label.

    Points with a cell's most frequent label are compared with the others only; if all pairs of labels were compared,
    none with the same one would have to be.
    """
    counts = stored(points.groupBy(*cell, "label").agg(F.count("*").alias("n")))
    most = counts.groupBy(*cell).agg(F.max(F.struct("n", "label"))["label"].alias("most"), F.count("*").alias("labels")).where("labels > 1")
    most = stored(most.select(*cell, "most"))
    rest = counts.join(F.broadcast(most), cell).where("label <> most").agg(F.sum("n")).first()[0]
    release(counts)
    if not rest:
        release(most)
        return None
    every = points.join(F.broadcast(most), cell)  # a row a cell
    left, right, tasks = shared(every.where("label <> most").drop("most"), every.drop("most"), cell, share(rest, BLOCK))
    found = against(left, right, [*cell, "part"], lambda held: Joined(held, least), "seed int, cx int, cy int, src bigint, dst bigint", min(2 * tasks, MOST_TASKS))
    return stored(found.distinct())


def clusters(members: DataFrame, vectors: DataFrame, radius: float = RADIUS, least: int = LEAST) -> DataFrame:
    """(seed, node, vec_id): components of the graph of cosine distances up to ``radius`` inside each cell.

    A node is named by its cell and smallest member; components of fewer than ``least`` members are noise.  Equal
    vectors are one point.  A cell's points are dealt to blocks by hash, and a task finds the components of one block
    and of a few points that visit all blocks of the cell, which join what blocks have found.  Points outside of a
    cell's largest component so far are then compared with all others of it.  That is all: points of one component need
    no comparison.  Where most points of a large cell hang together, work grows with the points and not with their square.
    """
    copies = stored(vectors.select("vec_id", F.xxhash64("embedding").alias("h"), F.col("embedding").alias("x")))
    reps = stored(copies.groupBy("h", "x").agg(F.min("vec_id").alias("rep")))
    owner = stored(copies.join(reps, ["h", "x"]).select("vec_id", "rep"))
    cell = ["seed", "cx", "cy"]
    points = stored(members.join(reps.select(F.col("rep").alias("vec_id"), "x"), "vec_id").select(*cell, "vec_id", "x"))
    sizes = points.groupBy(*cell).agg(F.count("*").alias("n"))
    sizes = stored(sizes.select(*cell, "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / max(1, BLOCK // VISITORS)).cast("int").alias("apart")))
    most, n = sizes.agg(F.max("blocks"), F.sum("n")).first()
    tasks = min(1 + (n or 0) // TASK_POINTS, MOST_TASKS)
    own = points.join(F.broadcast(sizes), cell).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    visits = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("apart")) == 0
    dealt = own.withColumn("part", F.explode(F.when(visits, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    dealt = dealt.select(*cell, "part", (F.col("part") != F.col("own")).alias("guest"), visits.alias("visits"), "vec_id", "x")
    schema = "seed int, cx int, cy int, root bigint, rep bigint, visits boolean, guest boolean"

    def task(key, rows):
        rows = rows.take(pa.array(np.argsort(rows["vec_id"].to_numpy())))
        ids, near = rows["vec_id"].to_numpy(), linked(units(rows), 1 - radius)
        n = len(ids)
        label, todo = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(n):
            if todo[i]:
                reached = np.array([i])
                while len(reached):
                    todo[reached], label[reached] = False, i
                    reached = np.flatnonzero(near[reached].any(axis=0) & todo)
        return pa.table([*(pa.array([k.as_py()] * n, pa.int32()) for k in key[:3]), pa.array(ids[label], pa.int64()), pa.array(ids, pa.int64()), rows["visits"], rows["guest"]], [*cell, "root", "rep", "visits", "guest"])

    forest = stored(dealt.repartition(tasks, *cell, "part").groupBy(*cell, "part").applyInArrow(task, schema))
    found = forest.where("not guest").select(*cell, "root", "rep")
    if (most or 1) > 1:
        large = F.broadcast(sizes.where("blocks > 1").select(*cell))

        def joined(found, edges):
            labels = min_labels(edges, tuple(cell)).select(*cell, F.col("node").alias("root"), "component")
            return found.join(labels, [*cell, "root"], "left").select(*cell, F.coalesce("component", "root").alias("root"), "rep")

        visited = forest.where("visits").join(large, cell, "left_semi").select(*cell, F.col("root").alias("src"), F.col("rep").alias("dst"))
        found = stored(joined(found, visited))
        labelled = points.join(large, cell, "left_semi").join(found.select(*cell, F.col("rep").alias("vec_id"), F.col("root").alias("label")), [*cell, "vec_id"])
        edges = _linked_labels(stored(labelled), cell, 1 - radius)
        found = found if edges is None else stored(joined(found, edges))
    release(points)
    placed = found.join(owner, "rep")
    large = stored(placed.groupBy(*cell, "root").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*cell, "root"))
    return placed.join(large, [*cell, "root"]).select("seed", F.concat_ws("-", "cx", "cy", "root").alias("node"), "vec_id")


def nerve(nodes: DataFrame) -> DataFrame:
    """(seed, src, dst): nodes that share a member.  A point lies in four cells at most, so rows grow with the points."""
    b = nodes.select("seed", "vec_id", F.col("node").alias("dst"))
    return nodes.withColumnRenamed("node", "src").join(b, ["seed", "vec_id"]).where("src < dst").select("seed", "src", "dst").distinct()


def partition(nodes: DataFrame) -> DataFrame:
    """(seed, vec_id, node): each covered point's first node by name."""
    return nodes.groupBy("seed", "vec_id").agg(F.min("node").alias("node"))


def purity(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(seed, weighted, mean): the largest label's share of a node, weighted by size and plain."""
    counts = nodes.join(vectors.select("vec_id", "label"), "vec_id").groupBy("seed", "node", "label").agg(F.count("*").alias("n"))
    each = counts.groupBy("seed", "node").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return each.groupBy("seed").agg((F.sum("most") / F.sum("n")).alias("weighted"), F.avg(F.col("most") / F.col("n")).alias("mean"))
