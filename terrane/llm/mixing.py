"""Mixing sources to target weights: temperature, budgets, block permutations.

A source with the share p of all tokens gets a weight in proportion to p ** alpha.  alpha is 1 where that meets the
targets, else it is searched for between 0 and 1: the largest exponent whose weights reach the target entropy, raised
to the smallest one that keeps every source within the repetition limit.  Weights times the budget are token budgets,
and a source's budget is met by whole permutations of its documents, the blocks, and the start of one more.  Every
block has an order of its own.

All counting is done by Spark: each step of the two searches tries many exponents of both in one aggregation over the
sources' totals, and the last permutation's cut is found through bounded hash buckets, so that no source's documents meet in
one task.

Defined results: a null source is a source of its own; a document without tokens is in every whole permutation and
takes nothing from a budget; rows of one source with the same id (repeated rows) stand or fall together; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import fresh, small_or_none, stored
from terrane.operators.ranks import placed

#: Exponents tried at once, and how often; together the search is finer than 1e-9.
TRIED, DEEP = 32, 6
#: Documents a bucket has on average, and the most buckets of a source.
PER_BUCKET, BUCKETS = 256, 65_536
#: Most sources whose plan is broadcast; beyond it the join is shuffled, with salted sources.
SMALL, SALTS = 100_000, 64


@dataclass(frozen=True)
class Target:
    """entropy: the least entropy of the weights as a share of the logarithm of the number of sources; close: the share
    of the gap between the sources' own entropy and that logarithm that the weights close at least; repetition: how often
    a source's documents may be used on average; budget: tokens of the mixture as a share of the input's."""

    entropy: float = 0.95
    close: float = 0.5
    repetition: float = 2.0
    budget: float = 1.0
    seed: int = 17


def token_count(text: Column) -> Column:
    """Words between white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _rank(seed: int, key: Column, row_id: Column) -> Column:
    """A document's place in its source's last permutation: 60 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key, row_id.cast("string"))), 1, 15), 16, 10).cast("long")


def solve_exponent(totals: DataFrame, target: Target) -> float:
    """The exponent for sources with the column ``tokens`` (positive)."""
    n, whole = totals.agg(F.count("*"), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0
    share = totals.select((F.col("tokens") / float(whole)).alias("p"))

    def measure(tried: list[float]) -> list[tuple[float, float, float]]:
        """(exponent, entropy, largest repetition) of all tried, by one aggregation."""
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(tried)]))
        raw = share.select("p", at.alias("g")).select("p", "g.i", F.pow("p", F.col("g.a")).alias("w"))
        rows = raw.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("s"), F.max(F.col("w") / F.col("p")).alias("r")).collect()
        return [(tried[r["i"]], math.log(r["z"]) - r["s"] / r["z"], target.budget * r["r"] / r["z"]) for r in sorted(rows, key=lambda r: r["i"])]

    def grid(lo: float, hi: float) -> list[float]:
        return [lo + (hi - lo) * i / TRIED for i in range(TRIED + 1)]

    def edge(measured: list[tuple[float, float, float]], good) -> tuple[float, float]:
        """The last exponent of a run of good ones from the first, and the first bad one; the same twice where there is none."""
        first = next((k for k, g in enumerate(measured) if not good(g)), None)
        if first is None or first == 0:
            return (measured[-1 if first is None else 0][0],) * 2
        return measured[first - 1][0], measured[first][0]

    whole_range = measure(grid(0.0, 1.0))
    own, most = next(h for a, h, _ in whole_range if a == 1.0), math.log(n)
    least = max(target.entropy * most, own + target.close * (most - own)) - 1e-12
    goods = (lambda g: g[1] >= least), (lambda g: g[2] > target.repetition)
    found = [edge(whole_range, good) for good in goods]
    for _ in range(DEEP - 1):  # both searches go on together
        going = [k for k, (lo, hi) in enumerate(found) if lo < hi]
        if not going:
            break
        finer = measure([a for k in going for a in grid(*found[k])])
        for j, k in enumerate(going):
            found[k] = edge(finer[j * (TRIED + 1) : (j + 1) * (TRIED + 1)], goods[k])
    spread, within = found[0][0], found[1][1]
    return max(spread, within)


def with_copies(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", target: Target = Target(), out: str = "copies") -> DataFrame:
    """``docs`` with how often the mixture uses each row, and the weight of its source as ``<out>_weight``."""
    key, rank = _key(F.col(source_col)), _rank(target.seed, _key(F.col(source_col)), F.coalesce(F.col(id_col).cast("string"), F.lit("-")))
    measured = stored(docs.select(key.alias("key"), rank.alias("rank"), token_count(F.col(text_col)).alias("tokens")))
    per_source = stored(measured.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    alpha = solve_exponent(per_source.where("tokens > 0"), target)
    norm, whole = per_source.where("tokens > 0").agg(F.sum("tokens").cast("double"), F.sum("tokens")).first()
    z = per_source.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(norm or 1.0), F.lit(alpha)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(norm or 1.0), F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    plan = per_source.select("key", "tokens", weight.alias("weight"), F.floor(weight * F.lit(float(target.budget * (whole or 0)))).alias("budget"), F.least(F.ceil(F.col("n") / PER_BUCKET), F.lit(BUCKETS)).alias("buckets"))
    plan = stored(plan.select("key", "weight", "buckets", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long").alias("whole"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest")))

    bucket = F.least(F.floor(F.col("rank") / float(1 << 60) * F.col("buckets")), F.col("buckets") - 1)
    dealt = _by_key(measured, plan).select("key", "rank", "tokens", "rest", bucket.alias("bucket"))
    sums = stored(dealt.groupBy("key", "rest", "bucket").agg(F.sum("tokens").alias("tokens")))
    up_to = F.expr("sum(tokens) over (partition by key order by bucket)")  # BUCKETS rows of a key at most
    partly = sums.select("key", "bucket", "rest", "tokens", up_to.alias("end")).where("end > rest and end - tokens <= rest")
    edge = stored(partly.select("key", F.col("bucket").alias("edge"), (F.col("rest") - F.col("end") + F.col("tokens")).alias("left")))
    inside = _by_key(dealt, edge).where("bucket = edge").groupBy("key", "left", "rank").agg(F.sum("tokens").alias("tokens"))
    inside = inside.select("key", "rank", F.expr("sum(tokens) over (partition by key order by rank)").alias("end"), "left")
    cut = plan.join(edge, "key", "left").join(inside.where("end <= left").groupBy("key").agg(F.max("rank").alias("last")), "key", "left")
    # below the edge's bucket everything is in, in it up to the last rank that fits; without an edge the whole source fits
    first_of_edge = F.ceil(F.col("edge") / F.col("buckets") * float(1 << 60)).cast("long") - 1
    cut = stored(cut.select("key", "weight", "whole", F.when(F.col("edge").isNull(), F.when(F.col("rest") > 0, F.lit(1 << 60)).otherwise(F.lit(-1))).otherwise(F.coalesce("last", first_of_edge)).alias("last")))

    k, r = fresh(docs, "mix_key"), fresh(docs, "mix_rank")
    side = cut.select(F.col("key").alias("key_"), F.col("weight").alias("weight_"), F.col("whole").alias("whole_"), F.col("last").alias("last_"))
    side = side.toDF(*[fresh(docs, c) for c in side.columns])
    names = dict(zip(("key_", "weight_", "whole_", "last_"), side.columns, strict=True))
    used = (F.col(names["whole_"]) + F.when(F.col(r) <= F.col(names["last_"]), 1).otherwise(0)).cast("long")
    joined = _by_key(docs.withColumn(k, key).withColumn(r, rank), side, k, names["key_"])
    return joined.select(*[c for c in docs.columns if c not in (out, f"{out}_weight")], used.alias(out), F.col(names["weight_"]).alias(f"{out}_weight"))


def _by_key(rows: DataFrame, plan: DataFrame, left: str = "key", right: str = "key") -> DataFrame:
    """Rows with the plan of their source: by broadcast where the plan is small, else by a join on salted sources."""
    small = small_or_none(plan, SMALL)
    if small is not None:
        return rows.join(small, left) if left == right else rows.join(small, F.col(left) == F.col(right))
    salt = fresh(rows, "salt")
    spread = plan.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns[:4]), F.lit(SALTS)).cast("int"))
    if left == right:
        return salted.join(spread, [left, salt]).drop(salt)
    other = f"{salt}_plan"
    spread = spread.withColumnRenamed(salt, other)
    return salted.join(spread, (F.col(left) == F.col(right)) & (F.col(salt) == F.col(other))).drop(salt, other)


def mixture(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """(doc_id, source, block, place, weight): a row for every use of a document; block is the permutation, from 0, and
    place the document's place in its source's block, from 0."""
    used = with_copies(docs.select("doc_id", "source", "text"), target=target)
    rows = used.where("copies > 0").select("doc_id", "source", _key(F.col("source")).alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("block"), F.round("copies_weight", 9).alias("weight"))
    order = F.md5(F.concat_ws("|", F.lit(str(target.seed)), "block", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    at = placed(rows.withColumn("h", order), ["key", "block"], ["h", "doc_id"])
    return at.select("doc_id", "source", "block", F.col("place").cast("long").alias("place"), "weight")


def mixed_documents(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The documents as often as the mixture uses them, in their own columns."""
    copies = fresh(docs, "mix_copies")
    used = with_copies(docs, target=target, out=copies)
    return used.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
