"""Logistic regression accuracy: hold-out, folds, and the router over two corpora."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.vectors import as_doubles, hash_rank
from terrane.operators.ranks import placed
from terrane.sources.tables import stored


def encoded(rows: DataFrame, label: str = "label", out: str = "y") -> DataFrame:
    """``rows`` with the label's place among the sorted distinct labels, from 0; Spark broadcasts the labels if they are few."""
    names = placed(rows.select(F.col(label).alias("l_")).distinct(), [], ["l_"], "p_")
    return rows.join(names, F.col(label) == F.col("l_")).withColumn(out, F.col("p_").cast("int")).drop("l_", "p_")


def prefixed(rows: DataFrame, side: str, label: str = "label") -> DataFrame:
    """Labels of a corpus kept apart from other corpora's."""
    return rows.withColumn(label, F.concat(F.lit(f"{side}:"), F.col(label).cast("string")))


def stacked(a: DataFrame, b: DataFrame, vector: str = "embedding") -> DataFrame:
    """Both corpora (id, label, vector) with their side and prefixed labels; vectors of different length are an error."""
    sizes = a.select(F.size(vector).alias("d")).union(b.select(F.size(vector).alias("d"))).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("both corpora must be embedded by the same encoder")
    return prefixed(a, "a").withColumn("side", F.lit("a")).unionByName(prefixed(b, "b").withColumn("side", F.lit("b")))


def stratified_folds(rows: DataFrame, folds: int, seed: int = 42, label: str = "label", row_id: str = "vec_id", fallback: bool = True) -> DataFrame:
    """``rows`` with ``fold``: a label's rows take turns in the order of a hash, so folds hold equal shares of it.

    If a label has fewer rows than there are folds, rows take turns without regard to labels (``fallback``).
    """
    hashed = rows.withColumn("h_", hash_rank(seed, F.col(row_id)))
    small = fallback and not rows.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < folds).isEmpty()
    turns = placed(hashed, [] if small else [label], ["h_", row_id], "turn_")
    return turns.withColumn("fold", (F.col("turn_") % folds).cast("int")).drop("turn_", "h_")


def balanced(train: DataFrame) -> DataFrame:
    """Weights that make every label count the same."""
    sizes = train.groupBy("y").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("whole"), F.count("*").alias("labels"))
    return train.join(sizes.crossJoin(F.broadcast(whole)), "y").withColumn("w", F.col("whole") / (F.col("labels") * F.col("n")))


def predicted(train: DataFrame, test: DataFrame) -> DataFrame:
    model = LogisticRegression(labelCol="y", weightCol="w", standardization=False, regParam=1e-3, maxIter=50).fit(balanced(train))
    return model.transform(test)


def _features(rows: DataFrame) -> DataFrame:
    return encoded(rows).withColumn("features", array_to_vector(as_doubles(F.col("embedding")))).withColumn("y", F.col("y").cast("double"))


def accuracy(vectors: DataFrame, folds: int = 5, only: int | None = 0, seed: int = 42) -> DataFrame:
    """(fold, accuracy, n) of one held-out fold, or of each."""
    rows, out = stored(stratified_folds(vectors, folds, seed)), None
    rows = _features(rows).select("features", "y", "fold").persist()
    for k in range(folds) if only is None else (only,):
        p = predicted(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k))
        one = p.agg(F.lit(k).alias("fold"), F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def routes(rows: DataFrame) -> DataFrame:
    """(accuracy_a, accuracy_b, a_to_b, b_to_a, classes) of predictions (side, label, predicted): shares of each side's
    rows that get their own label, and a label of the other side; NULL for a side without rows."""
    share = lambda side, hit: F.avg(F.when(F.col("side") == side, hit.cast("double")))
    own, other = F.col("label") == F.col("predicted"), ~F.col("predicted").startswith(F.concat("side", F.lit(":")))
    return rows.agg(share("a", own).alias("accuracy_a"), share("b", own).alias("accuracy_b"), share("a", other).alias("a_to_b"), share("b", other).alias("b_to_a"))


def router(a: DataFrame, b: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """``routes`` of one classifier over both corpora's labels, on a held-out fold of both.

    The fold is stratified unless a label is too small for that.
    """
    both = stored(stratified_folds(stacked(a.select("vec_id", "label", "embedding"), b.select("vec_id", "label", "embedding")).withColumn("id_", F.concat_ws(":", "side", "vec_id")), folds, seed, row_id="id_"))
    rows = _features(both).select("features", "y", "label", "side", "fold").persist()
    names = rows.select(F.col("y").alias("prediction"), F.col("label").alias("predicted")).distinct()  # a row per label
    out = predicted(rows.where("fold <> 0"), rows.where("fold = 0")).join(names, "prediction")
    return routes(out).crossJoin(rows.agg(F.countDistinct("label").alias("classes")))


def router_per_corpus(a: DataFrame, b: DataFrame, seed: int = 42) -> DataFrame:
    """(accuracy_a, accuracy_b): two classifiers, each on its own corpus."""
    return accuracy(a, seed=seed).select(F.col("accuracy").alias("accuracy_a")).crossJoin(accuracy(b, seed=seed).select(F.col("accuracy").alias("accuracy_b")))
