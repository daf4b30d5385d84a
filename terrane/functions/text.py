"""Surface features of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("lexicon_count", "sentence_count", "avg_sentence_length", "syllable_count", "flesch_reading_ease", "difficult_words")


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with FEATURES.  Syllables are vowel groups; a difficult word has three of them or more."""
    t = F.coalesce(F.col(text), F.lit(""))
    vowels = F.lit("[aeiouy]+")
    words, sentences = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+")).cast("double"), F.greatest(F.regexp_count(t, F.lit(r"[.!?]+")), F.lit(1)).cast("double")
    hard = F.size(F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)), lambda w: F.regexp_count(w, vowels) >= 3)).cast("double")
    df = df.withColumn("lexicon_count", words).withColumn("sentence_count", sentences).withColumn("syllable_count", F.regexp_count(F.lower(t), vowels).cast("double")).withColumn("difficult_words", hard)
    ease = 206.835 - 1.015 * F.col("lexicon_count") / F.col("sentence_count") - 84.6 * F.col("syllable_count") / F.greatest(F.col("lexicon_count"), F.lit(1.0))
    return df.withColumn("avg_sentence_length", F.col("lexicon_count") / F.col("sentence_count")).withColumn("flesch_reading_ease", ease)


def standardizer(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row: mean and population deviation (0 counts as 1) of each column."""
    dev = [F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"sd_{c}") for c in columns]
    return df.agg(*[F.avg(c).alias(f"mu_{c}") for c in columns], *dev)


def z_scores(df: DataFrame, fit: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """``df`` with z_<column> by another table's standardizer (one row, so its broadcast is bounded)."""
    return df.crossJoin(F.broadcast(standardizer(fit, columns))).select(*df.columns, *[((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).alias(f"z_{c}") for c in columns])
