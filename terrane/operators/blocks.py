"""Comparisons of all points of a group: shares of its points are held, and the whole group is streamed past them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a block, shares that all points are to make, blocks of a share at most, rows that are compared at once, and
#: pairs of which a cosine is taken in double precision at once.
BLOCK, SHARES, SHARE, AT_ONCE, PAIRS = 2048, 32, 32, 512, 1 << 16


def matrix(rows: pa.Table | pa.RecordBatch, name: str = "x") -> np.ndarray:
    """Vectors (n, d) of a column of lists as doubles; lists of different lengths are an error."""
    column = rows[name]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if n and not column.null_count:
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes == sizes[0]).all():
            return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return np.array(column.to_pylist(), np.float64).reshape(n, -1)


def units(rows: pa.Table | pa.RecordBatch, name: str = "x") -> np.ndarray:
    """Vectors (n, d) of length one; zero vectors stay."""
    x = matrix(rows, name)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def slack(d: int) -> float:
    """How far a cosine of unit vectors of ``d`` entries can be off in single precision."""
    return (d + 8) * 1.2e-7


def cosines(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows ``a`` of ``x`` with the rows ``b`` of ``y`` one by one, in double precision; PAIRS are copied at once."""
    out = np.empty(len(a))
    for s in range(0, len(a), PAIRS):
        out[s : s + PAIRS] = np.einsum("ij,ij->i", x[a[s : s + PAIRS]], y[b[s : s + PAIRS]])
    return out


def linked(x: np.ndarray, least: float) -> np.ndarray:
    """(n, n): which unit vectors have a cosine of ``least`` or more; single precision decides but for those close to it."""
    single = x.astype(np.float32)
    s = single @ single.T
    near = s >= least
    a, b = np.divmod(np.flatnonzero(np.abs(s - np.float32(least)).ravel() <= slack(x.shape[1])), max(len(x), 1))
    near[a, b] = cosines(x, a, x, b) >= least
    return near


def share(points: int, block: int = BLOCK) -> int:
    """Points of a share of ``points``, so that few shares have to meet their whole group."""
    return min(max(points // SHARES, block), SHARE * block)


def against(left: DataFrame, right: DataFrame, key: list[str], start: Callable, schema: str, tasks: int) -> DataFrame:
    """What ``start(left rows of a key)`` has found when it met all right rows of the key, piece by piece.

    Both have the same columns; keys are integers.  A task holds the left rows of one key, which should be a share, and
    a batch of right rows; ``meet`` takes the batch and ``out`` gives the result as record batches.
    """
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    order = [*key, "side"]

    def run(batches):
        now, held, state = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in order])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                mine, part = tuple(at[:-1, s].tolist()), b.slice(s, e - s)
                if mine != now:
                    if held:
                        yield from (state or start(pa.Table.from_batches(held))).out()
                    now, held, state = mine, [], None
                if at[-1, s] == 0:
                    held.append(part)
                elif held:
                    state = state or start(pa.Table.from_batches(held))
                    state.meet(part)
        if held:
            yield from (state or start(pa.Table.from_batches(held))).out()

    return both.repartition(max(tasks, 1), *key).sortWithinPartitions(*order).mapInArrow(run, schema)


def shared(left: DataFrame, right: DataFrame, group: list[str], size: int, name: str = "vec_id") -> tuple[DataFrame, DataFrame, int]:
    """``left`` with its ``part``, of ``size`` rows about, ``right`` once for each part of its group, and how many parts."""
    counts = left.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias("parts"))
    many = counts.agg(F.sum("parts")).first()[0] or 0
    join = lambda df: df.join(F.broadcast(counts), group) if group else df.crossJoin(F.broadcast(counts))  # noqa: E731  a row a group
    own = join(left).withColumn("part", F.pmod(F.xxhash64(name), F.col("parts")).cast("int")).drop("parts")
    return own, join(right).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), many


class Nearest:
    """The ``many`` nearest of held points among those that pass, by cosine distance, ties by id."""

    def __init__(self, key: dict[str, pa.Scalar], held: pa.Table, many: int) -> None:
        self.key, self.many, self.ids, self.x = key, many, held["vec_id"].to_numpy(), units(held)
        self.single, self.least = self.x.astype(np.float32), np.full(len(self.x), -np.inf, np.float32)
        none = np.zeros(0, np.int64)
        self.found = {s: (none, none.astype(np.float64), none, none) for s in range(0, len(self.x), AT_ONCE)}

    def meet(self, rows: pa.RecordBatch) -> None:
        ids, y, weight = rows["vec_id"].to_numpy(), units(rows), rows["weight"].to_numpy()
        single, off = y.astype(np.float32), slack(y.shape[1])
        for s, found in self.found.items():
            c, least = self.single[s : s + AT_ONCE] @ single.T, self.least[s : s + AT_ONCE].copy()
            near = c >= least[:, None]
            loose = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * (self.many + 1))  # no bound yet, or one from few points
            if len(loose):
                own = c[loose]
                own[np.isnan(own)] = -np.inf
                least[loose] = np.maximum(least[loose], np.partition(own, -self.many - 1, axis=1)[:, -self.many - 1] - 2 * off)  # a point meets itself
                near[loose] = c[loose] >= least[loose, None]
            a, b = np.divmod(np.flatnonzero(near.ravel()), len(y))
            other = self.ids[s + a] != ids[b]
            a, b = a[other], b[other]
            if not len(a):
                continue
            d = np.round(1 - cosines(self.x, s + a, y, b), 12)
            row, d, at, w = (np.concatenate(p) for p in zip(found, (a, d, ids[b], weight[b]), strict=True))
            order = np.lexsort((at, d, row))
            row, d, at, w = row[order], d[order], at[order], w[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < self.many
            row, d, at, w = row[kept], d[kept], at[kept], w[kept]
            self.found[s] = (row, d, at, w)
            last = np.searchsorted(row, np.arange(len(least)), side="right") - 1
            full = np.bincount(row, minlength=len(least)) == self.many
            self.least[s : s + AT_ONCE][full] = 1 - d[last[full]] - off

    def out(self):
        for s, (row, d, at, w) in self.found.items():
            keys = [pa.array([v.as_py()] * len(row), v.type) for v in self.key.values()]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(self.ids[s + row], pa.int64()), pa.array(at, pa.int64()), pa.array(d, pa.float64()), pa.array(w, pa.int64())], [*self.key, "vec_id", "other", "d", "weight"])


def neighbours(points: DataFrame, many: int, block: int = BLOCK, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, vec_id, other, d, weight): each point's ``many`` nearest others of its group by cosine distance, ties by id.

    ``points``: (group, vec_id, x, weight).  Work is the square of a group's points, dealt to shares that each meet the
    whole group; what is shuffled is the group once for each of its shares, and what tasks return the nearest only.
    Distances are rounded to 12 digits, so that they don't depend on how points were dealt.
    """
    g = list(group)
    left, right, tasks = shared(points, points, g, share(points.count(), block))
    types = [points.schema[c].dataType.simpleString() for c in g]
    schema = ", ".join([*(f"{c} {t}" for c, t in zip(g, types, strict=True)), "vec_id bigint, other bigint, d double, weight bigint"])
    return against(left, right, [*g, "part"], lambda held: Nearest({c: held[c][0] for c in g}, held, many), schema, min(2 * tasks, 1024))
