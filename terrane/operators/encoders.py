"""Texts to vectors: a hook for encoders that run in tasks, a seeded random projection, pooling, and checks of norms."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.sources.tables import stored

BUCKETS, DIMENSIONS = 4096, 64
#: Most texts that are tallied at once.
TEXTS = 256


def encode(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> DataFrame:
    """(id, embedding) of (id, text): ``load`` runs once in a task and gives a function from texts to a matrix.

    Null texts are empty.  No shuffle.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        f = load()
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                x = np.asarray(f([t or "" for t in part.column(1).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["id", "embedding"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")


class Tallies:
    """How many trigrams of each text have which value below ``width``, ``of`` giving a trigram's value.

    A trigram's value is looked up in a table over the first LETTERS letters that a task has seen, which is filled when a
    trigram first comes up; trigrams with other letters are told apart by sorting.  Texts are padded with two blanks on
    both sides and lower-case; one of fewer than three characters has none.  Work is in pieces of PIECE characters.
    """

    LETTERS, PIECE = 256, 1 << 20

    def __init__(self, of: Callable[[bytes], int], width: int) -> None:
        self.of, self.width, self.seen = of, width, 0
        self.letter = np.full(0x110000, -1, np.int32)
        self.value = np.full(self.LETTERS**3, -1, np.int32)
        self.rare: dict[int, int] = {}

    def values(self, c: np.ndarray) -> np.ndarray:
        """Values of the trigrams that begin at each of the characters ``c`` but the last two."""
        at = self.letter[c]
        if (at < 0).any():
            for new in np.unique(c[at < 0]).tolist():
                if self.seen < self.LETTERS:
                    self.letter[new], self.seen = self.seen, self.seen + 1
            at = self.letter[c]
        few = (at[:-2] >= 0) & (at[1:-1] >= 0) & (at[2:] >= 0)
        code = (at[:-2] * self.LETTERS + at[1:-1]) * self.LETTERS + at[2:]
        code[~few] = 0
        out = self.value[code]
        todo = np.flatnonzero(few & (out < 0))
        if len(todo):
            codes, first = np.unique(code[todo], return_index=True)
            self.value[codes] = [self.of("".join(map(chr, c[i : i + 3].tolist())).encode()) for i in todo[first].tolist()]
            out = self.value[code]
        rest = np.flatnonzero(~few)
        if len(rest):
            key = (c[rest].astype(np.int64) << 42) | (c[rest + 1].astype(np.int64) << 21) | c[rest + 2]
            keys, first, back = np.unique(key, return_index=True, return_inverse=True)
            for k, i in zip(keys.tolist(), rest[first].tolist(), strict=True):
                if k not in self.rare:
                    self.rare[k] = self.of("".join(map(chr, c[i : i + 3].tolist())).encode())
            out[rest] = np.array([self.rare[k] for k in keys.tolist()], np.int32)[back]
            if len(self.rare) > 1 << 20:
                self.rare.clear()
        return out

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, value, how many) of what there is, in order."""
        chars = [np.frombuffer(f"  {t}  ".encode("utf-32-le"), np.uint32) if t is not None else np.zeros(0, np.uint32) for t in texts]
        sizes = np.array([len(c) for c in chars], np.int64)
        c, whose = np.concatenate([*chars, np.zeros(0, np.uint32)]), np.repeat(np.arange(len(texts)), sizes)
        counts = np.zeros(len(texts) * self.width, np.int64)
        for s in range(0, max(len(c) - 2, 0), self.PIECE):
            part = c[s : s + self.PIECE + 2]
            value, own = self.values(part), whose[s : s + len(part)]
            inside = own[:-2] == own[2:]
            counts += np.bincount(own[:-2][inside] * self.width + value[inside], minlength=len(counts))
        there = np.flatnonzero(counts)
        return there // self.width, there % self.width, counts[there]


def tallied(texts: DataFrame, of: Callable[[bytes], int], width: int, made: Callable, schema: str) -> DataFrame:
    """What ``made`` (number of texts, text number, value, how many) returns of some (id, text) at a time, with their ids;
    each of its arrays comes with the numbers of the texts that its rows belong to.  No shuffle."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        tallies = Tallies(of, width)
        for b in batches:
            s, sizes = 0, pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            while s < b.num_rows:
                e = s + 1
                chars = int(sizes[s])
                while e < b.num_rows and e - s < TEXTS and chars + int(sizes[e]) <= Tallies.PIECE:
                    chars, e = chars + int(sizes[e]), e + 1
                whose, columns = made(e - s, *tallies.of_texts(b.column(1).slice(s, e - s).to_pylist()))
                if len(whose):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s).take(pa.array(whose)), *columns.values()], ["id", *columns])
                s = e

    return texts.select("id", F.lower("text").alias("text")).mapInArrow(run, f"id {kind}, {schema}")


def once(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(texts whose id no other one has, the other texts); the latter are None if there are none."""
    again = stored(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again")))
    if again.isEmpty():
        return texts, None
    on = texts["id"].eqNullSafe(again["again"])
    return texts.join(again, on, "left_anti"), texts.join(again, on, "left_semi")


def hashed(seed: int, g: bytes) -> str:
    """The digest by which ``hash_rank`` orders a text."""
    return hashlib.md5(b"%d:%s" % (seed, g)).hexdigest()


def _values(buckets: int, seed: int) -> Callable[[bytes], int]:
    return lambda g: int(hashed(seed, g)[:4], 16) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, seed: int = 3) -> DataFrame:
    """(id, bucket, n): how many trigrams of a text fall into each hash bucket; texts of one id count together."""
    single, several = once(texts)
    made = lambda n, whose, value, many: (whose, {"bucket": pa.array(value, pa.int64()), "n": pa.array(many, pa.int64())})
    count = lambda df: tallied(df, _values(buckets, seed), buckets, made, "bucket bigint, n bigint")
    return count(single) if several is None else count(single).union(count(several).groupBy("id", "bucket").agg(F.sum("n").alias("n")))


def bucket_figures(texts: DataFrame, buckets: int = BUCKETS, seed: int = 3) -> DataFrame:
    """(id, buckets, trigrams, most): of each text how many buckets its trigrams fall into, how many it has, and the largest bucket."""

    def made(n, whose, value, many):
        there, first = np.unique(whose, return_index=True)
        if not len(there):
            return there, {}
        figures = {"buckets": np.diff(np.append(first, len(whose))), "trigrams": np.add.reduceat(many, first), "most": np.maximum.reduceat(many, first)}
        return there, {c: pa.array(v, pa.int64()) for c, v in figures.items()}

    single, several = once(texts)
    out = tallied(single, _values(buckets, seed), buckets, made, "buckets bigint, trigrams bigint, most bigint")
    if several is None:
        return out
    return out.union(bucket_counts(several, buckets, seed).groupBy("id").agg(F.count("*").alias("buckets"), F.sum("n").alias("trigrams"), F.max("n").alias("most")))


def signed_buckets(texts: DataFrame, dimensions: int = 16, seeds: tuple[int, int] = (3, 4)) -> DataFrame:
    """(id, dim, x): trigrams of a text by hash bucket, those with a sign by another hash counting downwards."""

    def value(g: bytes) -> int:
        return 2 * (int(hashed(seeds[0], g)[:4], 16) % dimensions) + (hashed(seeds[1], g)[0] < "8")

    def made(n, whose, value, many):
        at, back = np.unique(whose * dimensions + value // 2, return_inverse=True)
        x = np.bincount(back, np.where(value % 2, many, -many), minlength=len(at)).astype(np.int64)
        return at // dimensions, {"dim": pa.array(at % dimensions, pa.int64()), "x": pa.array(x, pa.int64())}

    return tallied(texts, value, 2 * dimensions, made, "dim bigint, x bigint").groupBy("id", "dim").agg(F.sum("x").alias("x"))


def random_projection(texts: DataFrame, dimensions: int = DIMENSIONS, buckets: int = BUCKETS, seed: int = 0) -> DataFrame:
    """(id, embedding): bucket counts times a normal matrix of standard deviation 1 / sqrt(buckets), which every task draws anew.

    A matrix of counts holds TEXTS rows at most, so that memory doesn't grow with texts; texts of one id add up.
    """
    single, several = once(texts)
    draw = lambda: np.random.default_rng(seed).normal(0, buckets**-0.5, (buckets, dimensions))
    held = []

    def made(n, whose, value, many):
        if not held:
            held.append(draw())
        counts = np.zeros((n, buckets))
        counts[whose, value] = many
        x = counts @ held[0]
        there = np.unique(whose)
        return there, {"x": pa.array(list(x[there]), pa.list_(pa.float64()))}

    count = lambda df: tallied(df, _values(buckets, 3), buckets, made, "x array<double>")
    out = count(single)
    if several is not None:
        added = F.array(*[F.sum(F.col("x")[i]) for i in range(dimensions)]).alias("x")
        out = out.union(count(several).groupBy("id").agg(added))
    return out.select("id", F.col("x").cast("array<float>").alias("embedding"))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Masked mean of an array of vectors; an empty mask counts as 1e-9."""
    both = F.arrays_zip(hidden.alias("h"), mask.alias("m"))
    start = F.transform(F.element_at(hidden, 1), lambda x: F.lit(0.0))
    total = F.aggregate(both, start, lambda s, p: F.zip_with(s, p["h"], lambda a, b: a + b.cast("double") * p["m"]))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)


def checked_unit(v: Column, tolerance: float = 1e-4) -> Column:
    """The vector if its length is 1 within the tolerance; else the query fails."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.abs(size - 1) <= tolerance, v).otherwise(F.raise_error(F.lit("a vector isn't of unit length")).cast("array<float>"))
