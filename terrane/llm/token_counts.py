"""Token counts for every context limit from an exact histogram of encoded lengths.

Documents are aggregated by source and encoded length; the histogram has a row per length that occurs, however many
documents there are.  Sums from the long end answer, for every limit, how many documents are longer and how many
tokens remain when texts are cut at the limit; the same sums give exact quantiles.

The report has a row for every length that occurs, one for each of LIMITS, and one for each of SHARES.

Defined results: a null text is empty and has no tokens, a null source is a group of its own, repeated rows count each
time, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import bpe
from terrane.llm.common import stored

#: Lengths of a group are dealt to at most this many ranges, so that running sums never meet in one task.
RANGES = 4096
#: Context limits and shares of documents that are always reported.
LIMITS, SHARES = (512, 1024, 2048, 4096, 8192, 16384, 32768, 131072), (0.5, 0.9, 0.95, 0.99, 1.0)


def lengths(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, tokens) of every document, by the numpy BPE encoder."""
    ids = bpe.encode_texts(docs.select(F.col(source_col).alias("source"), F.col(text_col).alias("text")), "text", ["source"])
    return ids.select("source", F.size("ids").cast("long").alias("tokens"))


def histogram(counted: DataFrame) -> DataFrame:
    """(source, tokens, documents) of (source, tokens)."""
    return counted.groupBy("source", "tokens").agg(F.count("*").alias("documents"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with longer and longer_tokens: documents, and their tokens, of that length or more.

    Sums run in two levels: over ranges of lengths, of which a source has at most RANGES, and inside a range.
    """
    width = stored(hist.groupBy("source").agg(F.floor(F.max("tokens") / RANGES).alias("step")))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = hist.withColumn("k", key("source")).join(width.select(key("source").alias("k"), (F.col("step") + 1).alias("step")), "k").withColumn("part", F.floor(F.col("tokens") / F.col("step")))
    parts = rows.groupBy("k", "part").agg(F.sum("documents").alias("d"), F.sum(F.col("documents") * F.col("tokens")).alias("t"))
    above = parts.select("k", "part", F.expr("sum(d) over (partition by k order by part desc) - d").alias("d"), F.expr("sum(t) over (partition by k order by part desc) - t").alias("t"))
    inner = rows.select("k", "part", "source", "tokens", "documents", F.expr("sum(documents) over (partition by k, part order by tokens desc)").alias("di"), F.expr("sum(documents * tokens) over (partition by k, part order by tokens desc)").alias("ti"))
    return inner.join(above, ["k", "part"]).select("source", "tokens", "documents", (F.col("di") + F.col("d")).alias("longer"), (F.col("ti") + F.col("t")).alias("longer_tokens"))


def _key(c: str = "source"):
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def at_limits(sums: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """(source, tokens, documents, longer, longer_tokens) for given limits: documents of that length, and those that are as
    long or longer with their tokens."""
    limit = F.explode(F.array(*[F.lit(n).cast("long") for n in limits]))
    rows = sums.withColumn("limit", limit)
    over = F.col("tokens") >= F.col("limit")
    first = F.min_by(F.when(over, F.struct("tokens", "documents", "longer", "longer_tokens")), F.when(over, F.col("tokens")))
    found = rows.groupBy(_key().alias("k"), "limit").agg(F.first("source").alias("source"), first.alias("f"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select("source", F.col("limit").alias("tokens"), zero(F.when(F.col("f.tokens") == F.col("limit"), F.col("f.documents"))).alias("documents"), zero(F.col("f.longer")).alias("longer"), zero(F.col("f.longer_tokens")).alias("longer_tokens"))


def quantiles(sums: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(source, share, tokens): the smallest length that at least a share of the source's documents don't exceed."""
    n = sums.groupBy(_key().alias("k")).agg(F.max("longer").alias("n"))
    rows = sums.withColumn("k", _key()).join(n, "k").withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    at = rows.where((F.col("n") - F.col("longer") + F.col("documents")) >= F.col("share") * F.col("n") - 1e-9)
    return at.groupBy("k", "share").agg(F.first("source").alias("source"), F.min("tokens").alias("tokens")).select("source", "share", "tokens")


def token_report(docs: DataFrame) -> DataFrame:
    """(source, kind, share, tokens, documents, longer, longer_tokens, kept_tokens): kind is "length" for every length that
    occurs, "limit" for LIMITS, and "quantile" for SHARES, whose tokens are the quantile.

    kept_tokens is what remains of the source when every document is cut at ``tokens``.
    """
    sums = stored(with_suffix_sums(stored(histogram(lengths(docs)))))
    names = ["source", "tokens", "documents", "longer", "longer_tokens"]
    cut = quantiles(sums, SHARES).withColumn("k", _key())
    same = sums.withColumn("k", _key()).drop("source")
    parts = (
        sums.select(*names, F.lit("length").alias("kind"), F.lit(None).cast("double").alias("share")),
        at_limits(sums, LIMITS).select(*names, F.lit("limit").alias("kind"), F.lit(None).cast("double").alias("share")),
        cut.join(same, ["k", "tokens"]).select(*names, F.lit("quantile").alias("kind"), "share"),
    )
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("k", _key())
    whole = sums.groupBy(_key().alias("k")).agg(F.max("longer_tokens").alias("all_tokens"))
    kept = F.col("all_tokens") - F.col("longer_tokens") + F.col("longer") * F.col("tokens")
    return rows.join(whole, "k").select("source", "kind", "share", "tokens", "documents", "longer", "longer_tokens", kept.alias("kept_tokens"))
