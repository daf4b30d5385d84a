"""Near-duplicate vectors by spherical-cap filters of structured random product codes.

A filter is a direction; a vector passes it if their cosine exceeds a bound.  Directions are products of small random
codes, one per block of coordinates, so that a vector's filters are list-decoded block by block, dropping prefixes that
can't reach the bound any more.  Vectors that share a filter are compared, blocks of rows by matrix products in double
precision.  Filters with many vectors are dealt as pairs of bounded blocks, so that none meets in one task.

The code is fitted on a sample of about SAMPLE vectors of each length: the bound is lowered until planted partners at
exactly the cosine asked for share a filter with RECALL of them, and vectors are centred by the sample's mean before
they are decoded if that makes fewer comparisons, since a direction that all vectors have in common would fill the
filters along it.  Cosines are always those of the vectors themselves.  Every vector is decoded.

A pair is counted at the smallest filter that its vectors share, found from a product of incidence matrices; tasks
return counts and a spanning forest, never pairs.  Exact copies are one vector with a multiplicity.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; repeated rows are copies of each other; vectors of different length don't link; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import connected_components, stored

COSINE = 0.95
#: Filters a random vector passes on average, and at least: a vector that passes fewer has its bound lowered.  With
#: these a pair at cosine 0.95 of random vectors of 64 dimensions shares a filter with probability 0.999.
PASSED = LEAST = 16
#: Vectors that a code is fitted on, the share of planted partners that share a filter with them, and vectors of a length
#: that are too few for a code and share one filter.
SAMPLE, RECALL, FEW = 1024, 0.997, 32
#: Vectors of a filter that are compared in one task, at most about twice as many.
BLOCK = 768


@dataclass(frozen=True)
class Code:
    """rotation (d, d), per block its codes (B, width), the bound that a filter's score has to exceed, and the centre."""

    rotation: np.ndarray
    codes: list[np.ndarray]
    bound: float
    centre: np.ndarray

    def passed(self, x: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """The filters of unit vectors, with the bound lowered in steps for those that pass fewer than ``least``."""
        z = x - self.centre
        size = np.linalg.norm(z, axis=1, keepdims=True)
        z = np.where(size > 1e-9, z / np.maximum(size, 1e-9), x)
        rows, names, todo, code = [], [], np.arange(len(z)), self
        while len(todo):
            row, name = code.decode(z[todo])
            enough = np.bincount(row, minlength=len(todo)) >= (least if code.bound > 0 else 0)
            rows.append(todo[row[enough[row]]])
            names.append(name[enough[row]])
            todo, code = todo[~enough], replace(code, bound=code.bound - 0.02)
        row, name = np.concatenate(rows), np.concatenate(names)
        order = np.lexsort((name, row))
        return row[order], name[order]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose score with the unit vectors x reaches the bound, by row and filter."""
        y = x @ self.rotation
        cuts = np.cumsum([c.shape[1] for c in self.codes])[:-1]
        dots = [p @ c.T / math.sqrt(len(self.codes)) for p, c in zip(np.split(y, cuts, axis=1), self.codes, strict=True)]
        best = [d.max(axis=1) for d in dots]
        row, name, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for j, d in enumerate(dots):
            rest = sum(best[j + 1 :], np.zeros(len(x)))
            score = total[:, None] + d[row]
            at, code = np.nonzero(score >= (self.bound - rest[row])[:, None])
            row, name, total = row[at], name[at] * d.shape[1] + code, score[at, code]
        return row, name


def make_code(n: int, sample: np.ndarray, cosine: float = COSINE, seed: int = 5) -> Code:
    """A code for n vectors like the unit vectors ``sample``, with about n / 8 filters."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    filters = max(512, n // 8)
    blocks = max(1, min(d, 3 if filters <= 64**3 else 4))
    each = max(2, math.ceil(filters ** (1 / blocks)))
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    widths = [len(w) for w in np.array_split(np.arange(d), blocks)]
    codes = [c / np.linalg.norm(c, axis=1, keepdims=True) for c in (rng.normal(size=(each, w)) for w in widths)]
    partner = rng.normal(size=sample.shape)
    partner -= (partner * sample).sum(axis=1, keepdims=True) * sample
    size = np.linalg.norm(partner, axis=1, keepdims=True)
    partner = cosine * sample + math.sqrt(1 - cosine * cosine) * np.divide(partner, size, out=np.zeros_like(partner), where=size > 1e-9)
    partner /= np.linalg.norm(partner, axis=1, keepdims=True)
    best = None
    for centre in (np.zeros(d), sample.mean(axis=0)):
        code = Code(rotation, codes, 1.0, centre)
        while True:
            row, name = code.passed(sample)
            if len(row) >= PASSED * len(sample) or code.bound <= 0:
                other, theirs = code.passed(partner)
                own = np.unique(np.concatenate((row, other)) * (1 << 40) + np.concatenate((name, theirs)), return_counts=True)
                met = len(np.unique(own[0][own[1] > 1] >> 40))
                if met >= RECALL * len(sample) or code.bound <= 0:
                    break
            code = replace(code, bound=code.bound - 0.02)
        _, full = np.unique(name, return_counts=True)
        cost = float(n) * n * (full / len(sample)) @ (full / len(sample)) / 64 + float(n) * len(row) / len(sample)
        if best is None or cost < best[0]:
            best = cost, code
    return best[1]


FOREST = pa.schema([("key", pa.string()), ("links", pa.int64()), ("root", pa.string())])


def compare(x: np.ndarray, lower: list[np.ndarray], weight: np.ndarray, names: np.ndarray, half: np.ndarray | None, cosine: float) -> pa.Table:
    """Counts and a forest of one filter's block pair.

    x: unit vectors, lower: the smaller filters they pass, weight: multiplicities, half: the side of each row when
    the two blocks differ (rows of the same side aren't compared), names: what rows are called.
    """
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    if half is not None:
        hit &= half[:, None] != half[None, :]
    own = np.flatnonzero(hit.any(axis=1))
    if not len(own):
        return FOREST.empty_table()
    hit, names, weight = hit[np.ix_(own, own)], names[own], weight[own]
    lower = [lower[i] for i in own]
    sizes = [len(p) for p in lower]
    _, col, times = np.unique(np.concatenate(lower), return_inverse=True, return_counts=True)
    row, use = np.repeat(np.arange(len(own)), sizes), times[col] > 1
    shared, col = np.unique(col[use], return_inverse=True)
    seen = np.zeros((len(own), len(shared)), np.float32)
    seen[row[use], col] = 1
    first = hit & (seen @ seen.T < 0.5)
    links = first @ weight
    order = np.argsort(np.argsort(names))
    label = order.copy()
    while True:
        least = np.minimum(label, np.where(hit, label[None, :], len(own)).min(axis=1))
        if (least == label).all():
            break
        label = least
    by_order = np.empty(len(own), object)
    by_order[order] = names
    return pa.table([pa.array(names.tolist(), pa.string()), pa.array(links.astype(np.int64)), pa.array(by_order[label].tolist(), pa.string())], FOREST)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row."""

    form = np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64

    def clean(batches):
        for b in batches:
            keys, data, dims = [], [], []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if e is None else e for e in v], np.float64) if v else np.zeros(0)
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                raw = x.tobytes()
                keys.append(hashlib.md5(raw).hexdigest() if good else None)
                data.append(x.astype(form).tobytes() if good else None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(data, pa.binary()), pa.array(dims, pa.int32())], ["id", "key", "x", "d"])

    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    rows = stored(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(clean, f"id {kind}, key string, x binary, d int"))
    reps = stored(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.first("x").alias("x"), F.first("d").alias("d"), F.min("id").alias("least")))
    sizes = reps.groupBy("d").agg(F.count("*").alias("n"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)  # keys are digests
    part = reps.join(sizes.where(F.col("n") >= FEW).withColumnRenamed("d", "d_"), F.col("d") == F.col("d_")).where(place * F.col("n") < 2 * SAMPLE)
    sample: dict[int, tuple[int, list]] = {}
    for r in part.select("d", "n", "key", "x").orderBy("d", "key").collect():  # about 2 SAMPLE vectors of a length
        sample.setdefault(r["d"], (r["n"], []))[1].append(bytes(r["x"]))
    if reps.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    linked = _linked(reps, {d: make_code(n, _unit(x[:SAMPLE], form), cosine) for d, (n, x) in sample.items()}, cosine, form)
    linked = stored(linked)
    parts = connected_components(linked.select(F.col("root").alias("src"), F.col("key").alias("dst")))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    named = stored(reps.select("key", "weight", "least").join(links, "key", "left").join(parts, F.col("key") == F.col("node"), "left").select("key", "weight", "least", "links", F.coalesce("component", "key").alias("part")))
    heads = named.groupBy("part").agg(F.min("least").alias("component_id")).withColumn("by", F.reverse("part")).drop("part")
    # keys are reversed, so that both sides are shuffled for the join and a hot key's rows can be split
    final = named.withColumn("by", F.reverse("part")).join(heads, "by").select(F.reverse("key").alias("turned"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    known = rows.where("key is not null").select("id", F.reverse("key").alias("turned")).join(final, "turned").select("id", F.col("links").cast("long").alias("n_links"), "component_id")
    other = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.unionByName(other).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _unit(data: list[bytes], form: type) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(data), form).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(reps: DataFrame, codes: dict[int, Code], cosine: float, form: type) -> DataFrame:
    """(key, links, root): counts of links and a forest.  Vectors of a length without a code share one filter."""
    shared = reps.sparkSession.sparkContext.broadcast(codes)

    def filters(batches):
        for b in batches:
            dims = b.column(3).to_numpy()
            for d in np.unique(dims):
                own = b.take(pa.array(np.flatnonzero(dims == d)))
                for a in range(0, own.num_rows, 1024):
                    part, code = own.slice(a, 1024), shared.value.get(int(d))
                    row, name = code.passed(_unit(part.column(1).to_pylist(), form)) if code else (np.arange(part.num_rows), np.zeros(part.num_rows, np.int64))
                    n = np.bincount(row, minlength=part.num_rows)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(name.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], ["key", "x", "weight", "d", "passed"])

    listed = stored(reps.select("key", "x", "weight", "d").mapInArrow(filters, "key string, x binary, weight bigint, d int, passed array<int>"))
    flat = listed.select("*", F.posexplode("passed").alias("nth", "filter")).withColumn("lower", F.slice("passed", F.lit(1), F.col("nth")))
    sizes = listed.select("d", F.explode("passed").alias("filter")).groupBy("d", "filter").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes.select(F.col("d").alias("d_"), F.bitwise_not("filter").alias("other"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = flat.withColumn("other", F.bitwise_not("filter")).join(sizes.withColumnRenamed("other", "other_"), (F.col("other") == F.col("other_")) & (F.col("d") == F.col("d_"))).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # a row meets every block of its filter, as the lower or the upper of the two
    paired = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("d", "filter", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"), "own", "key", "x", "weight", "lower")

    def task(name, rows):
        lo, hi = (v.as_py() for v in name[2:])
        x = _unit(rows["x"].to_pylist(), form)
        half = None if lo == hi else rows["own"].to_numpy() == hi
        return compare(x, [np.array(p, np.int64) for p in rows["lower"].to_pylist()], rows["weight"].to_numpy(), np.array(rows["key"].to_pylist(), object), half, cosine)

    return paired.groupBy("d", "filter", "lo", "hi").applyInArrow(task, "key string, links bigint, root string")
