"""Language identification by hierarchical discrimination.

A first layer of linear support vector machines tells language families apart, one-versus-one machines tell the
languages of a family apart.  Features are hashed byte 1- to 3-grams of the whole lower-case text.  Families are
learned too: languages whose mean features are alike are merged, until about the square root of their number remain.

Whether a text is in a learned language at all is another question than which: its features' cosine with the mean of
the language it is given has to reach what learned texts of that length reach.  That bound is learned from the learned
texts and from windows of them, and doesn't depend on the number of languages or families.

Defined results: null texts and texts without a letter give ``und`` with score 0; without any labelled text every
text gives ``und``; with one language every text with a letter gives it; no rows give no rows.  Rows are scored one by
one, so ties and repeated rows give repeated results.  A text of any length is read whole, in pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import byte_slices, fresh, release, stored
from terrane.operators.ranks import placed

#: Hash buckets of the n-grams, and how many different texts of each language are learned from at most.
BUCKETS, PER_LANGUAGE = 2048, 400
#: Most texts that are learned from in all.  With more than ROWS / PER_LANGUAGE languages each gets an equal share of
#: them, so that every language is learned.
ROWS = 16_000
#: Bytes of texts whose features are worked out at once.
PIECE = 1 << 20
#: Lengths (bytes) from which texts have bounds of their own for being in a learned language; shorter texts always are.
LENGTHS = (32, 64, 128, 256, 1024, 4096)
#: Texts of a length that set its bound at least, and the bound's share of their least cosine.
SEEN, SLACK = 20, 0.92
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors (n, BUCKETS): square roots of the shares of hashed byte n-grams."""
    data = [t.lower().encode("utf-8", "replace") + b" " for t in texts]
    counts = np.zeros((len(data), BUCKETS))
    pieces, held = [], 0  # (text, its bytes and the two after them, how many n-grams start here)
    for i, raw in enumerate(data):
        for a in range(0, len(raw), PIECE):
            part = raw[a : a + PIECE]
            if pieces and held + len(part) > PIECE:
                _count(pieces, counts)
                pieces, held = [], 0
            pieces.append((i, raw[a : a + PIECE + 2], len(part)))
            held += len(part)
    _count(pieces, counts)
    x = np.sqrt(counts)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _count(pieces: list[tuple[int, bytes, int]], counts: np.ndarray) -> None:
    """Add the n-grams of pieces of texts."""
    rows, place = np.unique([i for i, _, _ in pieces], return_inverse=True)
    sizes = np.array([len(r) for _, r, _ in pieces])
    raw = np.frombuffer(b"".join(r for _, r, _ in pieces) + b"\0\0", np.uint8).astype(np.int32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))  # bytes of the piece from here on
    at = np.repeat(sizes, sizes) - left
    inside = at < np.repeat([n for _, _, n in pieces], sizes)
    doc = np.repeat(place.astype(np.int32) * BUCKETS, sizes)
    key, n = raw[: len(left)], len(left)
    total = np.zeros(len(rows) * BUCKETS)
    for k in range(3):
        if k:
            key = key * 257 + raw[k : n + k]
        on = inside & (left > k)
        mixed = (key[on] * np.int32(-1640531527) >> 15) & (BUCKETS - 1)
        total += np.bincount(mixed + doc[on], minlength=len(total))
    counts[rows] += total.reshape(-1, BUCKETS)


def length_class(sizes: np.ndarray) -> np.ndarray:
    """0 for texts shorter than all of LENGTHS, else the number of those they reach."""
    return np.searchsorted(LENGTHS, sizes, "right")


def svm(x: np.ndarray, y: np.ndarray, steps: int = 400, reg: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the slope that turns margins into probabilities, for labels -1 and 1.

    Full-batch subgradient steps on the hinge loss, each class weighing the same, averaged over the second half.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b = np.zeros_like(w), 0.0
    for t in range(1, steps + 1):
        hit = np.where(y * (x @ w + b) < 1, y * share, 0.0)
        rate = 1 / (reg * (t + 100))
        w = w * (1 - rate * reg) + rate * (hit @ x)
        b += 0.1 * rate * reg * hit.sum() * 100
        if t > steps // 2:
            mean_w += w * 2 / steps
            mean_b += b * 2 / steps
    margins = y * (x @ mean_w + mean_b)
    slope = max(np.geomspace(0.25, 16, 13), key=lambda s: -(share * np.logaddexp(0, -s * margins)).sum())
    return mean_w, mean_b, float(slope)


@dataclass
class Model:
    """families: languages of each; gates: one machine a family against the others; pairs: (a, b) machines, a positive;
    means: unit mean features of each language; bounds: least cosine with them, by length class."""

    families: list[list[str]]
    gates: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]
    means: dict[str, np.ndarray]
    bounds: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """A language, a score from 0 to 1, and whether it is in that language at all, for each text."""
        langs, scores, clear = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.families else []
        for a in range(0, len(rows), 512):
            own = rows[a : a + 512]
            x = features([texts[i] for i in own])
            sizes = np.array([len(texts[i].encode("utf-8", "replace")) for i in own])
            for i, lang, score, good in zip(own, *self.place(x, sizes), strict=True):
                langs[i], scores[i], clear[i] = lang, score, good
        return langs, scores, clear

    def place(self, x: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``predict`` of texts by their features and bytes."""
        gate = 1 / (1 + np.exp(-np.clip((x @ self.gates[:, :-2].T + self.gates[:, -2]) * self.gates[:, -1], -50, 50)))
        gate /= gate.sum(axis=1, keepdims=True)
        family = gate.argmax(axis=1)
        langs, scores, near = [UNKNOWN] * len(x), np.zeros(len(x)), np.zeros(len(x))
        for f in np.unique(family):
            own, names = np.flatnonzero(family == f), self.families[f]
            chance = np.zeros((len(own), len(names)))
            for (i, p), (j, q) in combinations(enumerate(names), 2):
                m = self.pairs[p, q]
                s = 1 / (1 + np.exp(-np.clip((x[own] @ m[:-2] + m[-2]) * m[-1], -50, 50)))
                chance[:, i] += s
                chance[:, j] += 1 - s
            if len(names) == 1:
                chance += 1
            best = chance.argmax(axis=1)
            won = chance[np.arange(len(own)), best] / max(len(names) - 1, 1)
            scores[own] = np.clip(won * gate[own, f], 0, 1)
            near[own] = (x[own] * np.array([self.means[n] for n in names])[best]).sum(axis=1)
            for i, j in zip(own, best, strict=True):
                langs[i] = names[j]
        return langs, scores, near >= self.bounds[length_class(sizes)]


def families(mean: np.ndarray) -> list[list[int]]:
    """Rows of ``mean`` merged by average likeness until about the square root of their number remain."""
    like, size = mean @ mean.T, np.ones(len(mean))
    np.fill_diagonal(like, -np.inf)
    groups = {i: [i] for i in range(len(mean))}
    while len(groups) > max(1, round(len(mean) ** 0.5)):
        a, b = sorted(divmod(int(like.argmax()), len(mean)))
        row = (like[a] * size[a] + like[b] * size[b]) / (size[a] + size[b])
        row[[a, b]] = -np.inf
        row[np.isinf(like[a]) | np.isinf(like[b])] = -np.inf
        like[a], like[:, a] = row, row
        like[b], like[:, b] = -np.inf, -np.inf
        size[a] += size[b]
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups.values())


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """The two layers from features and their languages; without bounds, so that every text is clear."""
    names = sorted(set(langs))
    none = np.full(len(LENGTHS) + 1, -1.0)
    if not names:
        return Model([], np.zeros((0, BUCKETS + 2)), {}, {}, none)
    y = np.array(langs)
    mean = np.array([x[y == n].mean(axis=0) for n in names])
    groups = [[names[i] for i in g] for g in families(mean)]
    mean /= np.linalg.norm(mean, axis=1, keepdims=True)

    def machine(positive: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w, b, slope = svm(x[rows], np.where(positive[rows], 1.0, -1.0))
        return np.concatenate((w, [b, slope]))

    every = np.arange(len(y))
    one = np.concatenate((np.zeros(BUCKETS), [1.0, 1.0]))
    gates = np.array([machine(np.isin(y, g), every) if len(groups) > 1 else one for g in groups])
    pairs = {(p, q): machine(y == p, np.flatnonzero((y == p) | (y == q))) for g in groups for p, q in combinations(g, 2)}
    return Model(groups, gates, pairs, dict(zip(names, mean, strict=True)), none)


def train(docs: DataFrame, text_col: str, lang_col: str, usable: Column, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> Model:
    """Fit on the different texts of each language with the smallest hashes: ``per_language`` of them or its equal share
    of ``rows``, whichever is less (all, where there are fewer).

    Copies count once, so every language with a text that has a letter is learned, however its rows repeat.  More
    languages than ``rows`` are an error.  The driver gathers features, never texts; windows' features stay in tasks.
    """
    labelled = docs.where(usable & F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("h", F.xxhash64("text"))

    def smallest(batches):
        held = {}
        for b in batches:
            langs, h = b.column(0).dictionary_encode(), b.column(1).to_numpy(zero_copy_only=False)
            place = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                held[lang] = np.unique(np.concatenate((held.get(lang, h[:0]), h[place == i])))[:per_language]
        for lang, h in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h, pa.int64())], ["lang", "h"])

    # each task sends at most per_language hashes of a language; the largest of the smallest ones is the language's bound
    hashes = labelled.select("lang", "h").mapInArrow(smallest, "lang string, h bigint").distinct()
    smallest_ones = stored(placed(hashes, ["lang"], ["h"]).where(F.col("place") < per_language))
    languages = smallest_ones.where("place = 0").count()
    if languages > rows:
        raise ValueError(f"{languages} languages, of which at most {rows} can be learned")
    each = min(per_language, rows // max(languages, 1))
    bounds = smallest_ones.where(F.col("place") < each).groupBy("lang").agg(F.max("h").alias("bound"))
    chosen = labelled.join(F.broadcast(bounds), "lang").where("h <= bound").select("text", "lang", "h")  # bounds: ``rows`` rows at most

    def run(batches):
        seen = set()
        for b in byte_slices(batches, 0, PIECE, 256):
            new = []
            for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append((i, *key))
            if not new:
                continue
            texts = b.column(0).take(pa.array([i for i, _, _ in new])).to_pylist()
            whole, parts = features(texts).astype(np.float32), [_window(t, h) for t, (_, _, h) in zip(texts, new, strict=True)]
            near, sizes = features(parts).astype(np.float32), [len(p.encode("utf-8", "replace")) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k, _ in new], pa.string()), pa.array([h for _, _, h in new], pa.int64()), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (whole, near)), pa.array(sizes, pa.int64())], ["lang", "h", "x", "near", "size"])

    found = stored(chosen.mapInArrow(run, "lang string, h bigint, x binary, near binary, size bigint").dropDuplicates(["lang", "h"]))
    model = fit(*_gathered(found))
    model.bounds = _bounds(found, model)
    release(smallest_ones, found)
    return model


def _gathered(found: DataFrame) -> tuple[np.ndarray, list[str]]:
    """The features of the chosen texts, and their languages."""
    rows = found.select("lang", "x").toArrow()
    langs, x, at = rows["lang"].to_pylist(), np.empty((len(rows), BUCKETS), np.float32), 0
    for v in rows["x"]:
        x[at] = np.frombuffer(v.as_buffer(), np.float32)
        at += 1
    del rows
    order = sorted(range(len(langs)), key=lambda i: (langs[i], x[i].tobytes()))
    pa.default_memory_pool().release_unused()
    return x[order], [langs[i] for i in order]


def _bounds(found: DataFrame, model: Model) -> np.ndarray:
    """Under what all learned texts' windows of a length have; too few of them: the bound of the next shorter ones."""
    shared = found.sparkSession.sparkContext.broadcast(model.means)

    def least(batches):
        for b in batches:
            near = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, BUCKETS)
            cosines = (near * np.array([shared.value[n] for n in b.column(0).to_pylist()], np.float32).reshape(-1, BUCKETS)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(length_class(b.column(2).to_numpy())), pa.array(cosines.astype(np.float64))], ["c", "cosine"])

    rows = found.select("lang", "near", "size").mapInArrow(least, "c bigint, cosine double").groupBy("c").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    seen = {r["c"]: r for r in rows.collect()}
    bounds = model.bounds.copy()
    for c in range(1, len(bounds)):
        bounds[c] = SLACK * np.float32(seen[c]["least"]) if c in seen and seen[c]["n"] >= SEEN else bounds[c - 1]
    return bounds


def _window(text: str, h: int) -> str:
    """A part of a text, its length and place chosen by the text's hash: all lengths from 32 characters on."""
    n = min(len(text), 32 << h % 9)
    start = (h >> 8) % (len(text) - n + 1)
    return text[start : start + n]


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", clear_out: str | None = None) -> DataFrame:
    """``docs`` with two or three more columns, which replace columns of those names.  No shuffle.

    clear_out: whether the text is in the language at all, see above.
    """
    kept = docs.drop(*[c for c in (lang_out, score_out, clear_out) if c and c != text_col])
    place = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept.schema)]
    schema = T.StructType([*fields, T.StructField("p", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("k", T.BooleanType())])

    def run(batches):
        for b in byte_slices(batches, place, PIECE, 512):
            langs, scores, clear = shared.value.predict(b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(clear, pa.bool_())], schema.fieldNames())

    done = kept.toDF(*[f.name for f in fields]).mapInArrow(run, schema)
    done = done.toDF(*kept.columns, lang_out, score_out, clear_out or fresh(kept, "clear"))
    return done if clear_out else done.select(*done.columns[:-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document isn't learned from: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_of(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    model = train(docs, "text", "lang", ~held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in a learned language: rejected are those without a letter and those unlike any text of the language
    they'd be given.  Null texts go, repeated rows stay or go together, columns stay as they are."""
    lang, score, clear = fresh(docs, "lang_found"), fresh(docs, "lang_score"), fresh(docs, "lang_clear")
    model = train(docs, "text", "lang", ~held_out())
    return identify(docs, model, "text", lang, score, clear).where((F.col(lang) != UNKNOWN) & F.col(clear)).select(*docs.columns)
