"""Scoring texts with a class-factored log-bilinear model trained by noise-contrastive estimation.

Tokens are words between white space with A-Z in lower case, and an end per text.  The model has OUTPUTS outcomes: the
end, the WORDS most frequent words, and OTHERS classes of all other words by their last three bytes.  A context vector
is the sum of the input vectors of the tokens before, each scaled by a vector of its place.  It predicts the outcome's
group, then the outcome in the group; both are log-bilinear and normalised over all groups and over all outcomes of the
group, by matrix products over many contexts at once.  Within a class of other words a known word has the probability
(c - D) / N_class, c being its count in the training texts, and unknown words together the rest, D V_class / N_class
(absolute discounting), so that the probabilities of all known words and of an unknown one add up to one.

Texts are split twice: to count words, and to turn every text into the numbers of its outcomes, which are stored.
Training texts are dealt to shards of about SHARD tokens by a hash of id and text, so that a model depends on the texts
and not on how a table is split or how often a task is tried.  A round trains each of its shards from where the last
round ended, in noise-contrastive steps over all of its tokens and batches that grow up to BATCH, and Spark averages the
shards' parameters and step sizes, weighted by tokens.  The first round has one shard, which settles what the vectors'
directions mean; the second a quarter of all, the last one all.  Words whose
share of all tokens is at least one in HOT_SHARE (so at most HOT_SHARE words) are broadcast as sorted hashes; the counts
of all others meet the texts by a shuffled join.

Defined results: a null text is empty and has one token, its end; without training texts every count is 0; rows
are scored one by one, so repeated rows give repeated results, and repeated training rows count as often as they occur.
Of words with equal counts the smaller ones are outcomes of their own; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import byte_slices, string_hashes, stored, unsliced

#: Groups of outcomes, and outcomes of a group.
GROUPS, EACH = 64, 64
OUTPUTS = GROUPS * EACH
#: Words that are outcomes, and classes of other words; the one left is the end.
OTHERS = 1024
WORDS = OUTPUTS - 1 - OTHERS
#: Dimensions of the vectors, and tokens of a context.
WIDTH, BEFORE = 16, 3
#: At most this many words are broadcast, none longer than LONGEST bytes.
HOT_SHARE, LONGEST = 1_000_000, 64
#: Tokens of a shard unless there would be more than SHARDS, shares of the shards in each round of training (0: one), the
#: largest batch, noise samples of a batch at either level, and the adaptive rate.
SHARD, SHARDS, ROUNDS, BATCH, NOISE, RATE = 1 << 21, 1024, (0.0, 0.25, 1.0), 16384, 32, 0.1
#: Bytes of texts, and tokens, that are worked on at once.
SLICE, TOKENS = 1 << 22, 1 << 18
#: The end as a token: no word contains a blank.
END = " "


def outcome(rank: np.ndarray | int):
    """The outcome of a rank: 0 is the end, then words by frequency, then classes.  Ranks take turns in the groups."""
    return rank % GROUPS * EACH + rank // GROUPS


@dataclass
class Model:
    """hot, hot_count, hot_out: sorted hashes, counts and outcomes of the broadcast words; discount: D; mass, unknown: log10
    of N and of D V of every outcome that is a class; unigram: shares of outcomes."""

    hot: np.ndarray
    hot_count: np.ndarray
    hot_out: np.ndarray
    tokens: int
    distinct: int
    ends: int
    unigram: np.ndarray
    discount: float
    mass: np.ndarray
    unknown: np.ndarray
    params: dict[str, np.ndarray] = field(default_factory=dict)
    #: Sums of squared gradients, from which steps take their size.
    squares: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 3) -> Model:
        """Random vectors; biases that give every outcome its share."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        share, inner = self.shares()
        self.params = {"inputs": draw(OUTPUTS + 1, WIDTH), "near": np.ones((BEFORE, WIDTH), np.float32), "heads": draw(GROUPS, WIDTH), "head_bias": np.log(share).astype(np.float32), "outputs": draw(OUTPUTS, WIDTH), "bias": np.log(inner).ravel().astype(np.float32)}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.params.items()}
        return self

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the groups, and of the outcomes in their group."""
        parts = self.unigram.reshape(GROUPS, EACH)
        return parts.sum(axis=1), parts / parts.sum(axis=1, keepdims=True)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers of all texts, the distinct words (A-Z in lower case), and how many words each text has."""
    flat = unsliced(pc.fill_null(texts.cast(pa.large_string()), ""))
    _, offsets, data = flat.buffers()
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lower = raw + (((raw >= 65) & (raw <= 90)) << 5).astype(np.uint8)
    flat = pa.LargeStringArray.from_buffers(len(flat), offsets, pa.py_buffer(lower))
    lists = pc.ascii_split_whitespace(flat)
    coded = lists.values.dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    blank = pc.index(words, "").as_py() if len(words) else -1
    if blank >= 0:  # blanks at a text's ends split off empty words
        owner = np.repeat(np.arange(len(counts)), counts)[index != blank]
        index, counts = index[index != blank], np.bincount(owner, minlength=len(counts))
    return index, words, counts


def other_classes(words: pa.Array) -> np.ndarray:
    """The outcome of each word as one of the others, by a hash of its last three bytes."""
    words = unsliced(words.cast(pa.large_string()))
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw, code = np.frombuffer(data or b"", np.uint8), np.zeros(len(words), np.uint32)
    for j in range(3):
        at = ends[1:] - 1 - j
        have = at >= ends[:-1]
        code[have] = code[have] * np.uint32(257) + raw[at[have]] + np.uint32(1)
    mixed = (code.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(12)) % np.uint64(OTHERS)
    return outcome(1 + WORDS + mixed.astype(np.int64))


def count_words(texts: DataFrame) -> DataFrame:
    """(token, class, c) of a table with the one column text; the end is a token."""

    def run(batches):
        for b in byte_slices(batches, 0, SLICE):
            index, words, _ = split_words(b.column(0))
            n = np.bincount(index, minlength=len(words))
            have = np.flatnonzero(n)
            names = pa.concat_arrays([words.take(pa.array(have)).cast(pa.string()), pa.array([END], pa.string())])
            yield pa.RecordBatch.from_arrays([names, pa.array(other_classes(names), pa.int32()), pa.array(np.append(n[have], b.num_rows), pa.int64())], ["token", "class", "n"])

    return texts.mapInArrow(run, "token string, class int, n bigint").groupBy("token").agg(F.first("class").alias("class"), F.sum("n").alias("c"))


def prepare(counts: DataFrame) -> Model:
    """A model at its start, from all counts (token, class, c)."""
    tokens, distinct, ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("token") == END, F.col("c")))).first()
    tokens, ends = tokens or 0, ends or 0
    words = counts.where(F.col("token") != END)
    top = words.orderBy(F.desc("c"), "token").limit(WORDS).select("token", "c").toArrow()
    hot = words.where((F.col("c") * HOT_SHARE >= tokens) & (F.octet_length("token") <= LONGEST)).select("token", "class", "c").toArrow()
    hashes, count, out = string_hashes(_column(hot, "token", pa.string())), _column(hot, "c", pa.int64()).to_numpy(), _column(hot, "class", pa.int64()).to_numpy().copy()
    top_hashes, top_count = string_hashes(_column(top, "token", pa.string())), _column(top, "c", pa.int64()).to_numpy()
    top_out = outcome(np.arange(1, len(top_hashes) + 1))
    new = ~np.isin(hashes, top_hashes)
    hashes, count, out = (np.concatenate(x) for x in ((top_hashes, hashes[new]), (top_count, count[new]), (top_out, out[new])))
    order = np.argsort(hashes)
    mass, sizes = np.zeros(OUTPUTS), np.zeros(OUTPUTS)
    mass[outcome(0)], mass[top_out] = ends, top_count
    least, last = (int(top_count[-1]), top["token"][-1].as_py()) if len(top_count) == WORDS else (0, "")
    rest = words.where((F.col("c") < least) | (F.col("c") == least) & (F.col("token") > last)).groupBy("class")
    once, twice = 0, 0
    for r in rest.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).collect():  # OTHERS rows
        mass[r["class"]], sizes[r["class"]] = r["n"], r["v"]
        once, twice = once + r["one"], twice + r["two"]
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    full = sizes > 0
    return Model(hashes[order], count[order], out[order], tokens, distinct, ends, (mass + 1) / (mass + 1).sum(), discount, np.where(full, np.log10(np.where(full, mass, 1)), 0), np.where(full, np.log10(discount * np.where(full, sizes, 1)), 0)).start()


def _column(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([c.cast(kind) for c in table[name].chunks]) if table[name].num_chunks else pa.array([], kind)


IS_CLASS = np.zeros(OUTPUTS, bool)
IS_CLASS[outcome(np.arange(1 + WORDS, OUTPUTS))] = True


def numbered(docs: DataFrame, learned: Column, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(row, id, learned, ids, known, base, inner, rare, times) of every row.

    ids: outcomes of all tokens; base: the sum of log10(c + 1) of words; inner: the words' log10 shares of their classes;
    rare, times: the words whose counts aren't broadcast, which count as unknown in known, base and inner.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, params={}))

    def run(batches):
        m = shared.value
        number = TaskContext.get().partitionId() << 40
        for b in byte_slices(batches, 0, SLICE):
            index, words, n = split_words(b.column(0))
            rows, doc = len(n), np.repeat(np.arange(len(n)), n)
            h, out, count = string_hashes(words), other_classes(words), np.full(len(words), -1, np.int64)
            at = np.minimum(np.searchsorted(m.hot, h), max(len(m.hot) - 1, 0))
            if len(m.hot):
                found = m.hot[at] == h
                out[found], count[found] = m.hot_out[at[found]], m.hot_count[at[found]]
            inside = np.where(count > 0, np.log10(np.maximum(count, 1) - m.discount), m.unknown[out]) - m.mass[out]
            inside = np.where(IS_CLASS[out], inside, 0.0)
            lengths = np.concatenate(([0], np.cumsum(n + 1)))
            ids = np.full(int(lengths[-1]), outcome(0), np.int32)
            ids[np.arange(len(doc)) + doc] = out[index]  # an end after every text before
            c = count[index]
            sums = lambda w: np.bincount(doc, weights=w, minlength=rows)
            cold = np.flatnonzero(c < 0)
            code, times = np.unique(doc[cold] * max(len(words), 1) + index[cold], return_counts=True)
            of, word = code // max(len(words), 1), code % max(len(words), 1)
            lists = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))).astype(np.int32))
            names = words.take(pa.array(word)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(rows)), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)), pa.array(ids)), pa.array(sums(c > 0).astype(np.int64)), pa.array(sums(np.log10(np.maximum(count, 0) + 1.0)[index])), pa.array(sums(inside[index])), pa.ListArray.from_arrays(lists, names), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int64)))],
                ["row", "id", "learned", "ids", "known", "base", "inner", "rare", "times"],
            )
            number += rows

    out = f"row bigint, id {kind}, learned boolean, ids array<int>, known bigint, base double, inner double, rare array<string>, times array<bigint>"
    return docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), learned.alias("learned")).mapInArrow(run, out)


def contexts(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(tokens, BEFORE): the tokens before each token of its text, the nearest first; OUTPUTS stands before the first."""
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(ids)) - np.repeat(starts, sizes)
    out = np.full((len(ids), BEFORE), OUTPUTS, np.int32)
    for j in range(BEFORE):
        inside = np.flatnonzero(at > j)
        out[inside, j] = ids[inside - 1 - j]
    return out


def _lists(batches, column: int):
    """(batch, its ids, their sizes) in pieces of about TOKENS tokens, one text at least."""
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
            part = b.slice(a, z - a)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False), sizes[a:z]
            a = z


def vectors(p: dict[str, np.ndarray], before: np.ndarray) -> np.ndarray:
    return sum(p["inputs"][before[:, j]] * p["near"][j] for j in range(BEFORE))


def contrast(v: np.ndarray, out: np.ndarray, bias: np.ndarray, share: np.ndarray, noise: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gradient by the scores of every outcome: noise says how often each was drawn as noise for the whole batch."""
    x = v @ out.T
    x += bias - np.log(share * noise.sum()).astype(np.float32)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)  # the chance that an outcome comes from the data
    own = np.arange(len(v)), target
    up = 1 - x[own]
    x *= -noise.astype(np.float32)
    x[own] += up
    return x


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by index, as an array of n rows."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[index[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def train_step(m: Model, before: np.ndarray, target: np.ndarray, rng: np.random.Generator, sums: dict[str, np.ndarray], rate: float) -> None:
    """One noise-contrastive step at both levels, the noise shared by the batch; adaptive rates."""
    p, (share, inner), n = m.params, m.shares(), len(target)
    order = np.argsort((target // EACH).astype(np.int16), kind="stable")  # a group's tokens side by side
    before, target = before[order], target[order]
    group = target // EACH
    parts = [p["inputs"][before[:, j]] for j in range(BEFORE)]
    v = parts[0] * p["near"][0]
    for x, w in zip(parts[1:], p["near"][1:], strict=True):
        v += x * w
    with np.errstate(over="ignore"):
        by_head = contrast(v, p["heads"], p["head_bias"], share, rng.multinomial(NOISE, share), group)
        dv = by_head @ p["heads"]
        grads = {"heads": by_head.T @ v, "head_bias": by_head.sum(axis=0), "outputs": np.zeros_like(p["outputs"]), "bias": np.zeros_like(p["bias"])}
        cuts, noise = np.searchsorted(group, np.arange(GROUPS + 1)), rng.multinomial(NOISE, inner)
        for g in range(GROUPS):
            a, z, at = cuts[g], cuts[g + 1], slice(g * EACH, (g + 1) * EACH)
            if z > a:
                by_out = contrast(v[a:z], p["outputs"][at], p["bias"][at], inner[g], noise[g], target[a:z] - g * EACH)
                dv[a:z] += by_out @ p["outputs"][at]
                grads["outputs"][at], grads["bias"][at] = by_out.T @ v[a:z], by_out.sum(axis=0)
    grads["near"] = np.stack([np.einsum("ij,ij->j", dv, x) for x in parts])
    grads["inputs"] = _summed(before.T.astype(np.int16).ravel(), np.concatenate([dv * w for w in p["near"]]), OUTPUTS + 1)
    for name, g in grads.items():
        g /= n
        s = sums[name]
        s += g * g
        p[name] += rate * g / np.sqrt(s)


def _table(p: dict[str, np.ndarray]) -> np.ndarray:
    """Parameters as rows: outcomes and the start, groups, places."""
    out = np.zeros((OUTPUTS + 1 + GROUPS + BEFORE, 2 * WIDTH + 1))
    out[: OUTPUTS + 1, :WIDTH], out[:OUTPUTS, WIDTH:-1], out[:OUTPUTS, -1] = p["inputs"], p["outputs"], p["bias"]
    out[OUTPUTS + 1 : -BEFORE, :WIDTH], out[OUTPUTS + 1 : -BEFORE, -1], out[-BEFORE:, :WIDTH] = p["heads"], p["head_bias"], p["near"]
    return out


def _params(t: np.ndarray) -> dict[str, np.ndarray]:
    heads = t[OUTPUTS + 1 : -BEFORE]
    parts = {"inputs": t[: OUTPUTS + 1, :WIDTH], "outputs": t[:OUTPUTS, WIDTH:-1], "bias": t[:OUTPUTS, -1], "heads": heads[:, :WIDTH], "head_bias": heads[:, -1], "near": t[-BEFORE:, :WIDTH]}
    return {k: v.astype(np.float32) for k, v in parts.items()}


def train_round(rows: DataFrame, model: Model, number: int, shards: int) -> Model:
    """A pass over ``rows`` (ids, shard, key), each shard in one task's stream, in the order of keys; parameters and step
    sizes are averaged, weighted by tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, hot=None, hot_count=None, hot_out=None))

    def run(batches):
        base, shard, rng, seen = shared.value, None, None, 0
        m = replace(base, params={k: v.copy() for k, v in base.params.items()})
        sums = {k: v.copy() for k, v in base.squares.items()}
        for b, flat, sizes in _lists(batches, 0):
            if rng is None:
                shard = b.column(1)[0].as_py()
                rng = np.random.default_rng((number, shard))
            before, order, a = contexts(flat, sizes), rng.permutation(len(flat)), 0
            while a < len(order):
                own = order[a : a + min(BATCH, 256 + seen // 16)]
                train_step(m, before[own], flat[own], rng, sums, RATE)
                a, seen = a + len(own), seen + len(own)
        if not seen:
            return
        table = np.concatenate([_table(m.params), _table(sums)], axis=1) * seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table)), pa.int32()), pa.array(np.full(len(table), float(seen))), *map(pa.array, table.T)], ["row", "weight", *cols])

    cols = [f"v{j}" for j in range(2 * (2 * WIDTH + 1))]
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("key").select("ids", "shard")  # a shard a partition
    parts = dealt.mapInArrow(run, "row int, weight double, " + ", ".join(f"{c} double" for c in cols))
    found = parts.groupBy("row").agg(*[(F.sum(c) / F.sum("weight")).alias(c) for c in cols]).collect()  # OUTPUTS + GROUPS + 4 rows
    if not found:
        return model
    table = np.array([[r[c] for c in cols] for r in sorted(found, key=lambda r: r["row"])])
    params, squares = np.split(table, 2, axis=1)
    return replace(model, params=_params(params), squares=_params(squares))


def train(rows: DataFrame, model: Model) -> Model:
    """The model after all rounds over ``rows`` (id, ids)."""
    shards = max(1, min(SHARDS, -(-model.tokens // SHARD)))
    key = F.xxhash64("id", "ids")
    dealt = rows.select("ids", key.alias("key"), F.pmod(key, F.lit(shards)).cast("int").alias("shard"))
    for number, share in enumerate(ROUNDS):
        some = max(1, int(shards * share))
        model = train_round(dealt.where(F.col("shard") < some), model, number, some)
    return model


def log_probabilities(p: dict[str, np.ndarray], before: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithms of the outcomes' probabilities, normalised at both levels."""

    def chosen(v, out, bias, own):
        x = v @ out.T
        x += bias
        picked = x[np.arange(len(v)), own]
        high = x.max(axis=1)
        x -= high[:, None]
        np.exp(x, out=x)
        return picked - high - np.log(x.sum(axis=1))

    order = np.argsort((target // EACH).astype(np.int16), kind="stable")
    own, v = target[order], vectors(p, before[order])
    got, group = np.empty(len(target)), own // EACH
    for a in range(0, len(own), BATCH):  # batches that fit into the processor's cache
        got[a : a + BATCH] = chosen(v[a : a + BATCH], p["heads"], p["head_bias"], group[a : a + BATCH])
    cuts = np.searchsorted(group, np.arange(GROUPS + 1))
    for g in range(GROUPS):
        at = slice(g * EACH, (g + 1) * EACH)
        for a in range(cuts[g], cuts[g + 1], BATCH):
            z = min(a + BATCH, cuts[g + 1])
            got[a:z] += chosen(v[a:z], p["outputs"][at], p["bias"][at], own[a:z] - g * EACH)
    out = np.empty(len(target))
    out[order] = got
    return out


def score_texts(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, learned, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    counts = stored(count_words(docs.where(learned).select(F.col(text_col).alias("text"))))
    model = prepare(counts)
    rows = stored(numbered(docs, learned, model, id_col, text_col))
    model = train(rows.where("learned"), model)
    shared = docs.sparkSession.sparkContext.broadcast(model.params)

    def run(batches):
        for b, flat, sizes in _lists(batches, 0):
            scores = np.concatenate([log_probabilities(shared.value, x, flat[a : a + TOKENS]) for a in range(0, len(flat), TOKENS) for x in [_around(flat, sizes, a)]]) if len(flat) else flat
            total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=scores, minlength=len(sizes)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[1:6], pa.array(sizes), pa.array(b.column(6).to_numpy(zero_copy_only=False) + total)], ["row", "id", "learned", "known", "base", "n_tokens", "score"])

    scored = rows.select("ids", "row", "id", "learned", "known", "base", "inner").mapInArrow(run, f"row bigint, id {kind}, learned boolean, known bigint, base double, n_tokens bigint, score double")
    cold = counts.where((F.col("c") * HOT_SHARE < model.tokens) | (F.octet_length("token") > LONGEST)).select("token", "c", F.get(F.array(*[F.lit(float(u)) for u in model.unknown]), "class").alias("unknown"))
    loose = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("n"))
    met = loose.join(cold, "token").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.col("n") * (F.log10(F.col("c") - model.discount) - F.col("unknown"))).alias("known_more"), F.sum("n").alias("found"))
    end = float(np.log10(model.ends + 1.0))
    whole = float(np.log10(model.tokens + model.distinct + 1))
    return scored.join(met, "row", "left").select(
        F.col("id").alias(id_col), "learned", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0)) + F.lit(1 if model.tokens else 0)).cast("long").alias("n_known"), F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("score") + F.coalesce("known_more", F.lit(0.0))).alias("score"),
    )


def _around(flat: np.ndarray, sizes: np.ndarray, a: int) -> np.ndarray:
    """``contexts`` of the TOKENS tokens from a on."""
    if len(flat) <= TOKENS:
        return contexts(flat, sizes)
    lo, hi, ends = max(a - BEFORE, 0), min(a + TOKENS, len(flat)), np.cumsum(sizes)
    inner = np.diff(np.concatenate(([lo], ends[(ends > lo) & (ends < hi)], [hi])))
    return contexts(flat[lo:hi], inner)[a - lo :]


def lm_scores(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_texts(docs, ~out).select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
