"""Training pairs within a subset: random, or with text features at most or at least so far apart."""

from __future__ import annotations

import math
from collections.abc import Generator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.vectors import distance, hash_rank
from terrane.operators.corpus import largest_remainder
from terrane.operators.ranks import placed
from terrane.sources.tables import release, stored

#: Partners that an anchor is offered first: those that follow it in its subset's permutation.  Where they give too few
#: pairs, the rest of the subset is searched.
OFFERED = 24
BANDS = {"random": (0.0, float("inf")), "matched": (0.0, 0.5), "mismatched": (1.5, float("inf"))}
#: The largest of the windows that follow, each FASTER times the one before, for anchors with too few pairs so far.
WINDOW, FASTER = 384, 4
#: Most pairs whose ids are broadcast in a round of ``matchings``, some MB; beyond it the joins are shuffled.
FEW_PAIRS = 20_000
#: Rows of a block that a task compares with another one, the width of the cells by whose order rows become blocks, and
#: how many blocks, as a power of two, share an upper box.
BLOCK, CELL, UPPER = 2048, 0.5, 3


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled: files of short rows are small, but such a table in the driver is not."""
    return df.hint("merge")


def ring(rows: DataFrame, seed: int) -> DataFrame:
    """(subset, id, z, r, n): each row's place in its subset's permutation by hash, and the subset's size."""
    hashed = rows.select("subset", "id", "z", hash_rank(seed, F.col("id")).alias("h"))
    sizes = hashed.groupBy("subset").agg(F.count("*").alias("n"))  # one row per subset
    return placed(hashed, ["subset"], ["h", "id"], "r").join(sizes, "subset").select("subset", "id", "z", "r", "n")


def partners(ranked: DataFrame, steps: DataFrame) -> DataFrame:
    """(subset, anchor_id, positive_id, d, step) of ``steps``: (subset, anchor_id, za, r of the anchor, step, n)."""
    at = steps.select("subset", "anchor_id", "za", "step", ((F.col("r") + F.col("step")) % F.col("n")).alias("r"))
    other = ranked.select("subset", "r", F.col("id").alias("positive_id"), F.col("z").alias("zp"))
    return at.join(apart(other), ["subset", "r"]).select("subset", "anchor_id", "positive_id", distance(F.col("za"), F.col("zp")).alias("d"), "step")


def offered(ranked: DataFrame, anchors: DataFrame, after: int, many: int) -> DataFrame:
    """(subset, anchor_id, positive_id, d, step): each anchor (subset, id, z, r, n) with the rows from the one behind
    ``after`` to the ``many``-th after it in its ring."""
    steps = anchors.withColumn("step", F.explode(F.sequence(F.lit(after + 1), F.lit(many)).cast("array<bigint>"))).where("step < n")
    return partners(ranked, steps.select("subset", F.col("id").alias("anchor_id"), F.col("z").alias("za"), "r", "step", "n"))


def blocks(rows: DataFrame) -> DataFrame:
    """(block, subset, n, lo, hi, z, r, need) of (subset, n, z, r, need): near rows together, at most BLOCK, packed.

    Rows are sorted by the interleaved bits of their cells; equal cells are cut by place, so copies don't meet in a task.
    """
    cell = lambda i: F.greatest(F.lit(0), F.least(F.lit(31), F.floor(F.col("z")[i] / CELL).cast("int") + 16)).cast("bigint")
    code = sum((F.shiftleft(F.shiftright(cell(i), b).bitwiseAND(1), 6 * b + i) for b in range(5) for i in range(6)), F.lit(0))
    spread = rows.withColumn("code", F.when(F.size("z") == 6, code).otherwise(F.lit(0))).repartitionByRange("subset", "code", "r").sortWithinPartitions("subset", "code", "r")

    def pack(batches):
        for b in batches:
            subset = b.column(0).to_pylist()
            n, r, need = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 3, 4))
            z = np.array(b.column(2).to_pylist(), np.float64).reshape(len(r), -1)
            out, a = [], 0
            while a < len(r):
                e = a + 1
                while e < len(r) and e - a < BLOCK and subset[e] == subset[a]:
                    e += 1
                part = z[a:e]
                out.append((subset[a], n[a], part.min(axis=0).tolist(), part.max(axis=0).tolist(), part.tobytes(), r[a:e].tobytes(), need[a:e].tobytes()))
                a = e
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["subset", "n", "lo", "hi", "z", "r", "need"])

    packed = spread.select("subset", "n", "z", "r", "need").mapInArrow(pack, "subset string, n bigint, lo array<double>, hi array<double>, z binary, r binary, need binary")
    return stored(packed.withColumn("block", F.monotonically_increasing_id()))


def touching(anchors: DataFrame, every: DataFrame, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """(near, uppers): pairs (a, c) of blocks of a subset that can hold rows within the band, by their bounding boxes, and
    the pairs of upper boxes that they were looked for in.

    2^UPPER blocks in a row share an upper box.  Upper boxes of a subset meet each other; blocks only meet where their
    upper boxes do, keyed by both, so that no subset is one key of the larger join.
    """
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)

    def reach(a: str, c: str) -> Column:
        up, down = F.zip_with(f"lo_{c}", f"hi_{a}", lambda x, y: x - y), F.zip_with(f"lo_{a}", f"hi_{c}", lambda x, y: x - y)
        least = square(F.zip_with(up, down, lambda x, y: F.greatest(x, y, F.lit(0.0))))
        most = square(F.zip_with(up, down, lambda x, y: F.greatest(-x, -y)))
        return (least <= high * high * (1 + 1e-9)) & (most >= low * low * (1 - 1e-9))

    box = lambda df, p: df.select("subset", F.shiftright("block", UPPER).alias(f"u{p}"), F.col("block").alias(p), F.col("lo").alias(f"lo_{p}"), F.col("hi").alias(f"hi_{p}"))

    def upper(lower: DataFrame, p: str) -> DataFrame:
        sides = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size(f"lo_{p}") - 1).alias("i"), F.col(f"lo_{p}").alias("lo"), F.col(f"hi_{p}").alias("hi"))).alias("s")
        ends = lower.select("subset", f"u{p}", sides).groupBy("subset", f"u{p}", "s.i").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"))
        whole = ends.groupBy("subset", f"u{p}").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))  # a row a dimension
        return whole.select("subset", f"u{p}", F.col("b.lo").alias(f"lo_u{p}"), F.col("b.hi").alias(f"hi_u{p}"))

    la, lc = box(anchors, "a"), box(every, "c")
    uppers = stored(upper(la, "a").join(upper(lc, "c"), "subset").where(reach("ua", "uc")).select("subset", "ua", "uc"))
    return uppers.join(la, ["subset", "ua"]).join(lc, ["subset", "uc"]).where(reach("a", "c")).select("a", "c"), uppers


def searched(ranked: DataFrame, short: DataFrame, low: float, high: float, many: int = OFFERED) -> DataFrame:
    """(subset, r, step): the next admissible rows in the ring after the ``many`` offered ones, for (subset, n, z, r, need).

    Exact: a block of anchors meets every block of its subset that can have a row within the band.  A block returns at
    most the need of each anchor, so rows grow with anchors, not pairs.
    """
    anchors, every = blocks(short), blocks(ranked.select("subset", "n", "z", "r", F.lit(0).alias("need")))
    near, _ = touching(anchors, every, low, high)
    left = anchors.select(F.col("block").alias("a"), "subset", "n", F.col("z").alias("za"), F.col("r").alias("ra"), "need")
    both = near.join(apart(every.select(F.col("block").alias("c"), F.col("z").alias("zc"), F.col("r").alias("rc"))), "c").join(apart(left), "a")  # sorted by a, so a task merges what a block of anchors finds

    def first(at, step, need):
        order = np.lexsort((step, at))
        at, step = at[order], step[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < need[at]
        return at[keep], step[keep]

    def out(row, held):
        at, step = held
        ra = np.frombuffer(row["ra"], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([row["subset"]] * len(at), pa.string()), pa.array(ra[at]), pa.array(step)], ["subset", "r", "step"])

    def compare(batches):
        last = held = None
        for row in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
            if last is not None and last["a"] != row["a"]:
                yield out(last, held)
                held = None
            ra, rc, need = (np.frombuffer(row[k], np.int64) for k in ("ra", "rc", "need"))
            za, zc = (np.frombuffer(row[k], np.float64).reshape(len(r), -1) for k, r in (("za", ra), ("zc", rc)))
            found = [held] if held else []
            for s in range(0, len(ra), 256):
                d = np.zeros((len(ra[s : s + 256]), len(rc)))
                for i in range(za.shape[1]):
                    d += np.square(za[s : s + 256, i, None] - zc[None, :, i])
                d = np.sqrt(d)
                at, other = np.nonzero((d >= low) & (d <= high))
                at = at + s
                step = (rc[other] - ra[at]) % row["n"]
                fit = step > many
                found.append(first(at[fit], step[fit], need))
            last, held = row, first(*(np.concatenate(x) for x in zip(*found, strict=True)), need)
        if last is not None:
            yield out(last, held)

    return both.select("a", "subset", "n", "za", "ra", "need", "zc", "rc").mapInArrow(compare, "subset string, r bigint, step bigint")


def build(rows: DataFrame, kind: str, uses: int, seed: int) -> DataFrame:
    """(subset, anchor_id, positive_id, ts_dist, use, r): each anchor's first ``uses`` admissible partners and its place.

    Partners come in the order of the ring from the anchor on.  Windows of the ring are tried by joins, from OFFERED rows
    on, each for the anchors that have too few pairs so far; what is short behind WINDOW rows is searched for in the whole
    subset, so that an anchor has fewer than ``uses`` only if the subset has no more.
    """
    low, high = BANDS[kind]
    ranked = stored(ring(rows, seed))
    names = ["subset", "anchor_id", "positive_id", F.col("d").alias("ts_dist"), "use"]
    short = ranked.select("subset", "id", "n", "z", "r", F.lit(0).cast("long").alias("have"), F.lit(uses).alias("need"))
    parts, after, many = [], 0, OFFERED
    while many <= WINDOW:
        fit = offered(ranked, short, after, many).where((F.col("d") >= low) & (F.col("d") <= high))
        fit = fit.join(apart(short.select(F.col("id").alias("anchor_id"), "have")), "anchor_id")
        use = F.col("have") + F.row_number().over(W.partitionBy("anchor_id").orderBy("step"))
        parts.append(stored(fit.withColumn("use", use.cast("int")).where(F.col("use") <= uses).select(*names)))
        got = parts[-1].groupBy(F.col("anchor_id").alias("id")).agg(F.count("*").alias("got"))
        have = F.col("have") + F.coalesce("got", F.lit(0))
        left = short.where(F.col("n") > many + 1).join(apart(got), "id", "left").withColumn("have", have).where(F.col("have") < uses)
        left = stored(left.select("subset", "id", "n", "z", "r", "have", (F.lit(uses) - F.col("have")).alias("need")))
        short, after, many = left, many, many * FASTER
        if short.isEmpty():
            break
    else:
        found = searched(ranked, short.select("subset", "n", "z", "r", "need"), low, high, after)
        steps = found.withColumn("k", F.row_number().over(W.partitionBy("subset", "r").orderBy("step"))).join(apart(short), ["subset", "r"]).where(F.col("k") <= F.col("need"))
        more = partners(ranked, steps.select("subset", F.col("id").alias("anchor_id"), F.col("z").alias("za"), "r", "step", "n"))
        uses_of = steps.select(F.col("subset"), F.col("id").alias("anchor_id"), "step", (F.col("have") + F.col("k")).cast("int").alias("use"))
        parts.append(more.join(apart(uses_of), ["subset", "anchor_id", "step"]).select(*names))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(apart(ranked.select(F.col("id").alias("anchor_id"), "r")), "anchor_id").select("subset", "anchor_id", "positive_id", "ts_dist", "use", "r")


def guarded(rows: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``rows`` if all are training rows and none has an id of ``held``; else an error."""
    if "split" in rows.columns and not rows.where("split is distinct from 'train'").isEmpty():
        raise ValueError("there are rows whose split is not 'train'")
    if held is not None and not rows.join(held.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("there are ids of held-out rows")
    return rows


def wanted(rows: DataFrame, kind: str, many: int, seed: int, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, report): ``many`` pairs of training rows (id, subset, z), or all there are.

    A subset's quota is its share of ``many`` by largest remainder, met by its anchors' first pairs in the order of the
    ring.  What subsets fall short of is filled from all subsets: anchors' first pairs, then second ones, and so on, by
    hash.  No pair comes twice; pairs: (subset, anchor_id, positive_id, ts_dist, use, filled, place), place being the
    pair's place in a shuffle.  report: a row per subset, (subset, n, quota, pairs, shortfall, filled, max_use, anchors,
    dead), dead being anchors that were to be used once more and had no partner left.
    """
    if kind not in BANDS:
        raise ValueError(f"kind must be one of {tuple(BANDS)}")
    if many <= 0:
        raise ValueError("the number of pairs must be positive")
    rows = guarded(rows, held)
    sizes = stored(rows.groupBy("subset").agg(F.count("*").alias("n")))
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    uses = math.ceil(many / max(n, 1)) + 1
    every = stored(build(rows.select("id", "subset", "z"), kind, uses, seed))
    quota = stored(largest_remainder(sizes, many))
    ones = placed(every.where("use = 1"), ["subset"], ["r", "anchor_id"], "at").join(quota, "subset")
    met = stored(ones.where("at < quota").select("subset", "anchor_id", "positive_id", "ts_dist", "use"))
    left = many - met.count()
    rest = every.join(apart(met.select("anchor_id", "use")), ["anchor_id", "use"], "left_anti")
    by_use = stored(rest.groupBy("use").agg(F.count("*").alias("m")).select("use", "m", F.coalesce(F.sum("m").over(W.orderBy("use").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")))  # one row per use
    hashed = rest.withColumn("h", hash_rank(seed, F.col("use"), F.col("anchor_id")))
    more = placed(hashed, ["use"], ["h", "anchor_id"], "at").join(F.broadcast(by_use), "use").where(F.col("before") + F.col("at") < left)
    names = ["subset", "anchor_id", "positive_id", "ts_dist", "use"]
    chosen = met.withColumn("filled", F.lit(False)).unionByName(more.select(*names).withColumn("filled", F.lit(True)))
    shuffled = placed(chosen.withColumn("h", hash_rank(seed, F.col("anchor_id"), F.col("positive_id"))), [], ["h", "anchor_id", "positive_id"]).drop("h")
    pairs = stored(shuffled.select(*names, "filled", F.col("place").cast("long").alias("place")))
    last = pairs.agg(F.coalesce(F.max("use"), F.lit(1))).first()[0]
    have = every.groupBy("anchor_id").agg(F.count("*").alias("have"))
    dead = rows.select("subset", F.col("id").alias("anchor_id")).join(apart(have), "anchor_id", "left").where(F.coalesce("have", F.lit(0)) < last).groupBy("subset").agg(F.count("*").alias("dead"))
    built = pairs.groupBy("subset").agg(F.count("*").alias("pairs"), F.count_if("filled").alias("filled"), F.max("use").cast("long").alias("max_use"), F.countDistinct("anchor_id").alias("anchors"))
    report = sizes.join(quota, "subset").join(built, "subset", "left").join(dead, "subset", "left").na.fill(0)
    return pairs, report.select("subset", "n", "quota", "pairs", (F.col("quota") - F.col("pairs") + F.col("filled")).alias("shortfall"), "filled", "max_use", "anchors", "dead")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with both texts, from (id, text)."""
    return pairs.join(apart(texts.toDF("anchor_id", "anchor")), "anchor_id").join(apart(texts.toDF("positive_id", "positive")), "positive_id")


def negatives(pairs: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """(anchor_id, positive_id, negative_id): a row of all ``rows`` (id) for each pair, never one of its own two.

    Pairs and rows are placed by hash; a pair takes the row at its place, or the first after it that isn't its own.
    """
    ring_ = stored(placed(rows.select("id", hash_rank(seed + 2, F.col("id")).alias("h")), [], ["h", "id"], "k").select("id", "k"))
    n = ring_.count()
    at = placed(pairs.select("anchor_id", "positive_id", hash_rank(seed + 3, F.col("anchor_id"), F.col("positive_id")).alias("h")), [], ["h", "anchor_id", "positive_id"], "k")
    tries = at.select("anchor_id", "positive_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("k") + i) % max(n, 1)).alias("k")) for i in range(3)])).alias("t")).select("anchor_id", "positive_id", "t.i", "t.k")
    fit = tries.join(apart(ring_), "k").where((F.col("id") != F.col("anchor_id")) & (F.col("id") != F.col("positive_id")))
    return fit.groupBy("anchor_id", "positive_id").agg(F.min_by("id", "i").alias("negative_id"))


def matchings(pairs: DataFrame) -> Generator[DataFrame, DataFrame | None]:
    """Maximal sets of ``pairs`` (anchor_id, positive_id, h) in which no id comes twice, one after the other, until none are
    left; each is stored.

    A pair wins if no pair that shares an id with it has a smaller ``h``; winners take their ids out, and the rest go on
    until none is left.  Each step is an aggregation by id and joins with it, whatever order rows are in.
    """
    pool = stored(pairs)
    while n := pool.count():
        alive, won = pool, None
        while n:
            sent = F.broadcast if n <= FEW_PAIRS else apart
            ends = alive.select(F.explode(F.array("anchor_id", "positive_id")).alias("id"), "h")
            least = stored(ends.groupBy("id").agg(F.min("h").alias("least")), 2 * n)
            side = lambda c: sent(least.select(F.col("id").alias(c), F.col("least").alias(f"least_{c}")))  # noqa: B023, E731
            held = alive.join(side("anchor_id"), "anchor_id").join(side("positive_id"), "positive_id")
            new = stored(held.where("h = least_anchor_id and h = least_positive_id").select("anchor_id", "positive_id", "h"), n)
            won = new if won is None else won.unionByName(new)
            gone = sent(new.select(F.explode(F.array("anchor_id", "positive_id")).alias("gone")))
            rest = alive.join(gone, F.col("anchor_id") == F.col("gone"), "left_anti").join(gone, F.col("positive_id") == F.col("gone"), "left_anti")
            rest = stored(rest.select("anchor_id", "positive_id", "h"), n)
            release(least, *([] if alive is pool else [alive]))
            alive, n = rest, rest.count()
        release(alive)
        used = yield won
        left = stored(pool.join(apart((won if used is None else used).select("h")), "h", "left_anti"))
        release(pool)
        pool = left


def batches(pairs: DataFrame, size: int, seed: int) -> DataFrame:
    """(batch, anchor_id, positive_id): batches of ``size`` pairs in which no id comes twice.

    Pairs are ordered by hash.  A round takes a maximal set of pairs that share no id, of which ``size`` in a row are a
    batch; pairs behind its last full batch wait for the next round.  It ends with a round that doesn't fill one batch;
    what is left then is dropped.  A pair of an id with itself fills no place.  Equal pairs count once.
    """
    fit = pairs.where("anchor_id <> positive_id").select("anchor_id", "positive_id").distinct()
    hashed = fit.withColumn("h", F.concat_ws(":", hash_rank(seed, F.col("anchor_id"), F.col("positive_id")), F.col("anchor_id").cast("string"), F.col("positive_id").cast("string")))
    out, done, found = [], 0, matchings(hashed)
    won = next(found, None)
    while won is not None:
        full = won.count() // size
        if not full:
            break
        numbered = placed(won, [], ["h"], "place").where(F.col("place") < full * size)
        out.append(stored(numbered.select((F.floor(F.col("place") / size) + done).cast("long").alias("batch"), "anchor_id", "positive_id", "h")))
        done += full
        try:
            won = found.send(out[-1])
        except StopIteration:
            break
    whole = hashed.limit(0).select(F.lit(0).cast("long").alias("batch"), "anchor_id", "positive_id")
    for part in out:
        whole = whole.unionByName(part.drop("h"))
    return whole
