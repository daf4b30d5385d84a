"""Corpus frames, splits and samples.  Order is a column; every draw is a rank by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.vectors import hash_rank

SEED = 42


def corpus(documents: DataFrame) -> DataFrame:
    """(id, text, subset, domain) of the documents whose text isn't blank."""
    return documents.where(F.col("text").rlike(r"\S")).select(F.col("doc_id").alias("id"), "text", F.coalesce("source", F.lit("unknown")).alias("subset"), F.coalesce("lang", F.lit("unknown")).alias("domain"))


def contrast(conversations: DataFrame) -> DataFrame:
    """(id, text, subset, domain) of the turns whose text isn't blank, for evaluation next to the documents."""
    rows = conversations.where(F.col("text").rlike(r"\S"))
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", F.coalesce("role", F.lit("unknown")).alias("subset"), F.lit("conversation").alias("domain"))


#: Corpora by name: the table that each is read from, and how.
CORPORA = {"documents": ("documents", corpus), "conversations": ("conversations", contrast)}


def load(name: str, read) -> DataFrame:
    """A corpus by its name; ``read`` gives a table by its name.  Unknown names are an error."""
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name!r}; there are {', '.join(sorted(CORPORA))}")
    source, make = CORPORA[name]
    return make(read(source))


def stratified(rows: DataFrame, cap: int, label: str = "subset", row_id: str = "id", seed: int = SEED) -> DataFrame:
    """At most ``cap`` rows of each label, with their place ``rn`` in the draw; Spark limits groups before the shuffle."""
    order = W.partitionBy(label).orderBy(hash_rank(seed, F.col(row_id)), row_id)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)


def with_split(rows: DataFrame, cap: int, seed: int = SEED) -> DataFrame:
    """``rows`` with split and eval_order: the sample by label, then by draw; -1 in training.

    The place is an offset per label plus the place in the label, so that no window runs over all rows.
    """
    drawn = stratified(rows.select("id", "subset"), cap, seed=seed).select("id", "subset", "rn")
    sizes = drawn.groupBy("subset").count()
    offsets = sizes.select("subset", (F.sum("count").over(W.orderBy("subset").rowsBetween(W.unboundedPreceding, -1))).alias("offset"))
    placed = drawn.join(offsets, "subset").select("id", (F.coalesce("offset", F.lit(0)) + F.col("rn") - 1).cast("long").alias("place"))
    out = rows.join(placed, "id", "left")
    return out.select(*rows.columns, F.when(F.col("place").isNotNull(), "eval").otherwise("train").alias("split"), F.coalesce("place", F.lit(-1)).cast("long").alias("eval_order"))


def round_robin(rows: DataFrame, n: int, label: str = "subset", order: str = "eval_order") -> DataFrame:
    """The first n rows when labels take turns, in their old order.  A label gives n rows at most."""
    turn = F.row_number().over(W.partitionBy(label).orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", label).limit(n).drop("turn")


def largest_remainder(sizes: DataFrame, total: int) -> DataFrame:
    """(subset, quota) of (subset, n): proportional shares, the rest to the largest fractions, ties by name."""
    whole = sizes.agg(F.sum("n").alias("whole"))
    exact = sizes.crossJoin(F.broadcast(whole)).withColumn("exact", F.col("n") * total / F.col("whole"))
    floor = exact.withColumn("q", F.floor("exact"))
    left = floor.agg((F.lit(total) - F.sum("q")).alias("left"))
    by_rest = F.row_number().over(W.orderBy(F.desc(F.col("exact") - F.col("q")), "subset"))  # one row per label
    return floor.withColumn("r", by_rest).crossJoin(F.broadcast(left)).select("subset", (F.col("q") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def leaked(train: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """Training rows that held-out rows share; a guard wants none."""
    return train.join(held.select(on), on, "left_semi")
