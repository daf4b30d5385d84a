"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

Every element of a weighted set throws darts into its region (its weight times the ranks up to a limit).  An element's
darts arrive in order of rank, by hashes of the element alone, so that two sets see the same darts wherever their
regions overlap; the earliest dart of each coordinate is the signature.  Bands of coordinates make candidates.

Documents with the same words are one text from the start.  Within a bucket every text is compared with the smallest
one (a star, not all pairs).  Members that this leaves in several components meet other hubs, a few rounds long; the
pairs of different components that are left then are compared one by one, so that no candidate link between different
texts is lost: tasks compare signatures and return the pairs that may be links.  Links are verified on the shingles themselves, and the classes are the components of the links.

Similarity is the weighted Jaccard of shingles of five lower-case words between white space, each shingle weighing as
much as it occurs (1 with counts=False).  A text with fewer words is one shingle; null, empty and blank texts are
one text without words.  A class's document with the smallest id stays (null ids last); of repeated rows one stays.
"""

from __future__ import annotations

import math
from base64 import b64encode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import GOLDEN, M1, M2, byte_slices, connected_components, fresh, mix, small_or_none, release, stored, string_hashes, unsliced

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair misses all bands with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Most ids that are broadcast when texts are fetched; beyond it the join is shuffled.
SMALL = 1_000_000
#: Rounds in which split buckets meet hubs, and the pairs per member that are then compared as they are.
HUB_ROUNDS, FEW_PAIRS = 8, 4
#: Members of either side that are compared in one task; members of split buckets above which these are compared in
#: passes, each over a part of the buckets, and the most passes.
BLOCK, PASS, PASSES = 1024, 20_000, 6
#: Coordinates of the signatures that are compared there, of 2 bits each: two sets of similarity s agree in a share
#: s + (1 - s) / 4 of them.
COMPARED = 1024


def _uniform(x: np.ndarray) -> np.ndarray:
    u = (x >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u /= float(1 << 53)
    return u


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' lower-case words between white space, and how many words a text has."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(unsliced(texts).cast(pa.large_string()), "")))
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    words = unsliced(pc.utf8_trim_whitespace(lists.values))  # a text's last blank may be left as a word
    size = np.diff(np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]) if len(words) else np.zeros(0, np.int64)
    if (size == 0).any():  # blanks at a text's ends split off empty words
        n = np.bincount(np.repeat(np.arange(len(n)), n)[size > 0], minlength=len(n))
        words = words.filter(pa.array(size > 0))
    return string_hashes(words), n


def text_keys(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """A key of 96 bits as 16 characters for each text: the same for texts with the same words in the same order."""
    ends = np.cumsum(n)
    place = (np.arange(len(h)) - np.repeat(ends - n, n)).astype(np.uint64)
    parts = []
    for seed in (M1, M2):
        terms = mix(h ^ mix(place + seed))
        total = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        parts.append(mix((total[ends] - total[ends - n]) ^ n.astype(np.uint64)))
    raw = np.stack(parts, axis=1).view(np.uint8).reshape(len(n), 16)[:, :12].tobytes()
    return pa.array([b64encode(raw[i : i + 12]).decode() for i in range(0, len(raw), 12)], pa.string())


def shingle_hashes(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all texts in order, repeated ones too, and how many a text has."""
    size = np.minimum(n, WORDS)
    each = n - size + (n > 0)
    starts = np.cumsum(n) - n
    padded = np.concatenate((h, np.zeros(WORDS, np.uint64)))
    at = np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    rolled = np.zeros(len(h), np.uint64)
    for j in range(WORDS):
        rolled = mix(rolled ^ padded[j : j + len(h)])
    out = rolled[at]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):  # the one shingle of a text with fewer words
        part = np.zeros(len(short), np.uint64)
        for j in range(WORDS):
            part = np.where(j < n[short], mix(part ^ padded[starts[short] + j]), part)
        out[(np.cumsum(each) - each)[short]] = part
    return out, each


def distinct_shingles(s: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, sorted and distinct within a text; how often each occurs; how many a text has."""
    o = np.repeat(np.arange(len(each)), each)
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    return s[first], np.diff(np.append(first, len(s))), np.bincount(o[first], minlength=len(each))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(sets, k) uint64: for every set and coordinate the earliest dart.  Sets without elements get zeros.

    elements and weights are those of all sets in order, sizes how many each set has.  An element of weight 1 that is
    listed twice changes nothing: it throws the same darts again.
    """
    out = np.zeros((len(sizes), k), np.uint64)
    todo = np.flatnonzero(sizes)
    starts = np.cumsum(sizes) - sizes
    darts = k * (math.log(k) + 4.0)
    while len(todo):
        at = np.repeat(starts[todo] - (np.cumsum(sizes[todo]) - sizes[todo]), sizes[todo]) + np.arange(int(sizes[todo].sum()))
        e, w, row = elements[at], weights[at].astype(np.float64), np.repeat(np.arange(len(todo)), sizes[todo])
        limit = darts / np.bincount(row, weights=w, minlength=len(todo))
        best_rank, best = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, np.uint64)
        low, high = 0.0, 1.0  # layers of weight [0, 1), [1, 2), [2, 4), ...: each has darts of its own
        layer = 0
        while len(e):
            key = mix(mix(e ^ np.uint64(seed)) + np.uint64(layer))
            # the first throw: most elements of a long text stop at it, before any logarithm
            dart = mix(key + GOLDEN)
            live = np.flatnonzero(_uniform(dart) >= (np.exp(-limit * (high - low)) * (1 - 1e-12))[row])
            rank, dart, turn = np.zeros(len(live)), dart[None, live], 1
            while len(live):  # throws run down, elements across
                ranks = np.concatenate((rank[None], -np.log(_uniform(dart)) / (high - low))).cumsum(axis=0)[1:]
                inside = ranks <= limit[row[live]]
                spot = mix(dart ^ M1)
                hit = inside & (low + _uniform(spot) * (high - low) < w[live])
                r, d = ranks[hit], dart[hit]
                cell = np.broadcast_to(row[live] * k, hit.shape)[hit] + ((spot[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
                np.minimum.at(best_rank, cell, r)
                early = r == best_rank[cell]
                best[cell[early]] = d[early]
                live, rank = live[inside[-1]], ranks[-1, inside[-1]]
                turns = min(max((1 << 15) // max(len(live), 1), 1), 32)
                dart = mix(key[live] + np.arange(turn + 1, turn + turns + 1, dtype=np.uint64)[:, None] * GOLDEN)
                turn += turns
            on = w > high
            e, w, row = e[on], w[on], row[on]
            low, high, layer = high, high * 2, layer + 1
        full = np.isfinite(best_rank.reshape(len(todo), k)).all(axis=1)
        out[todo[full]] = best.reshape(len(todo), k)[full]
        todo = todo[~full]
        darts *= 2
    return out


def packed(signatures: np.ndarray) -> np.ndarray:
    """(sets, coordinates / 32) uint64: two bits of each coordinate."""
    n, k = signatures.shape
    parts = (signatures & np.uint64(3)).reshape(n, k // 32, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(parts, axis=2)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b): how many coordinates of packed signatures are equal."""
    differ = np.zeros((len(a), len(b)), np.int32)
    for c in range(a.shape[1]):
        x = a[:, c][:, None] ^ b[:, c][None, :]
        differ += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return 32 * a.shape[1] - differ


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets, bands) int64: a hash of each band's coordinates and its number."""
    n, k = signatures.shape
    parts = signatures.reshape(n, bands, k // bands)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for j in range(k // bands):
        h = mix(h ^ parts[:, :, j])
    return h.view(np.int64)


def raw_key(text) -> F.Column:
    """Finds a row's text again, next to its id; not a proof that texts are the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signed(docs: DataFrame, id_col: str, text_col: str, counts: bool = True) -> DataFrame:
    """(id, raw, key, bands array<long>) of every row; texts without words have no bands."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for b in byte_slices(batches, 2):
            h, n = word_hashes(b.column(2))
            s, each = shingle_hashes(h, n)
            times = np.ones(len(s))
            if counts:
                s, times, each = distinct_shingles(s, each)
            bands = band_hashes(dart_signatures(s, times, each, BANDS * ROWS))
            offsets = np.concatenate(([0], np.cumsum((each > 0) * BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[each > 0].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text_keys(h, n), lists], ["id", "raw", "key", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), raw_key(F.col(text_col)).alias("raw"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, raw bigint, key string, bands array<bigint>")


def expanded(s: np.ndarray, times: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets whose Jaccard similarity is the weighted one: an element that occurs n times becomes n elements."""
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    out = np.repeat(s, times)
    more = np.flatnonzero(nth)
    out[more] = mix(out[more] ^ nth[more].astype(np.uint64) * GOLDEN)
    ends = np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], np.cumsum(each)))]
    return out, np.diff(ends)


def shingled(texts: DataFrame, counts: bool = True) -> DataFrame:
    """(key, s array<long>): each text's distinct shingles or, with counts, all of them, ``expanded``."""

    def run(batches):
        for b in byte_slices(batches):
            h, words = word_hashes(b.column(0))
            s, times, each = distinct_shingles(*shingle_hashes(h, words))
            if counts:
                s, each = expanded(s, times, each)
            offsets = pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([text_keys(h, words), pa.ListArray.from_arrays(offsets, pa.array(s.view(np.int64)))], ["key", "s"])

    return texts.select("text").mapInArrow(run, "key string, s array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose weighted Jaccard similarity reaches the bound; where they are of few texts, only those
    texts' sets are shuffled."""
    need = pairs.select(F.col("src").alias("needed")).union(pairs.select("dst")).distinct()
    few = small_or_none(need, SMALL)
    sets = sets if few is None else sets.join(few, F.col("key") == F.col("needed"), "left_semi")
    a, b = (sets.select(F.col("key").alias(f"k{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, F.col("src") == F.col("ka")).join(b, F.col("dst") == F.col("kb"))
    least, whole = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return both.where(least >= similarity * (whole - least) - 1e-9).select("src", "dst")


def _likely(apart: DataFrame, sets: DataFrame, reps: DataFrame, similarity: float, passes: int = 1) -> DataFrame:
    """(src, dst): pairs of one bucket and different components whose signatures agree almost as often as links do.

    The smaller components' members are compared with all members, in tasks of bounded blocks of both, which return
    only the pairs whose share of equal coordinates is at most five standard deviations under the similarity.  A pair
    that shares several buckets is returned by that of the first band they agree in, and once.  The buckets are dealt
    to passes, one after the other, so that the rows of all of them are never on disk together.
    """

    def signatures(batches):
        for b in batches:
            s = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            each = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            full = packed(dart_signatures(s, np.ones(len(s)), each, COMPARED, seed=2))
            bands = np.ascontiguousarray(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(each), -1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (full, bands))], ["k", "sig", "bands"])

    wanted = apart.select(F.col("key").alias("key_w")).distinct()
    chosen = reps.join(wanted, F.col("key") == F.col("key_w"), "left_semi").select(F.col("key").alias("key_"), "bands")
    signed_sets = stored(sets.join(chosen, F.col("key") == F.col("key_")).select("key", "s", "bands").mapInArrow(signatures, "k string, sig binary, bands binary"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("key"), blocks(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    at = lambda i, j, minor: F.struct(i.alias("i"), j.alias("j"), F.lit(minor).alias("minor"))
    minor = F.when(F.col("part") != F.col("main"), each("all")).otherwise(F.array().cast("array<int>"))
    minor = F.transform(minor, lambda x: at(place("few"), x, True))
    every = F.transform(each("few"), lambda x: at(x, place("all"), False))
    share = similarity + (1 - similarity) / 4
    least = (share - 5 * math.sqrt(share * (1 - share) / COMPARED)) * COMPARED

    def task(rows):
        side = rows["minor"].to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint64).reshape(len(side), -1)
        bands = np.frombuffer(b"".join(rows["bands"].to_pylist()), np.int64).reshape(len(side), -1)
        band, major = rows["band"][0].as_py(), rows["major"].to_numpy(zero_copy_only=False)
        key, part = np.array(rows["key"].to_pylist(), object), np.array(rows["part"].to_pylist(), object)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        part = np.unique(part, return_inverse=True)[1]
        src, dst = [], []
        for lo in range(0, len(a), 64):
            own = a[lo : lo + 64]
            x, y = np.nonzero((agreeing(sig[own], sig[b]) >= least) & (part[own][:, None] != part[b][None, :]))
            x, y = own[x], b[y]
            once = major[y] | (key[x] < key[y])  # two members of smaller components meet twice
            x, y = x[once], y[once]
            same = bands[x] == bands[y]
            here = bands[x, same.argmax(axis=1)] == band
            src += key[x[here]].tolist()
            dst += key[y[here]].tolist()
        return pa.table([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])

    found = None
    for turn in range(passes):
        rows = apart.where(F.pmod(F.xxhash64("b"), F.lit(passes)) == turn).join(signed_sets, F.col("key") == F.col("k"))
        band = F.bitwise_not(F.reverse("b").cast("long")).alias("band")
        rows = rows.select("b", F.inline(F.concat(every, minor)), (F.col("part") == F.col("main")).alias("major"), band, "key", "part", "sig", "bands")
        some = rows.groupBy("b", "i", "j").applyInArrow(task, "src string, dst string")
        some = stored(some.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
        found = some if found is None else found.union(some)
    release(signed_sets)
    return found


def near_classes(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, similarity: float = SIMILARITY) -> DataFrame:
    """(key, class): of every different text that is like another one, its class's smallest key; rows: see ``signed``."""
    order = F.struct(F.col("id").isNull(), "id", "raw")
    reps = stored(rows.groupBy("key").agg(F.min_by(F.struct("id", "raw", "bands"), order).alias("r")).select("key", "r.*"))
    flat = reps.select("key", F.explode("bands").alias("band"))
    # the joins below are on another name of the bucket, so that both sides are shuffled for them and hot buckets can be split
    other = lambda df: df.withColumn("bucket", F.bitwise_not("band")).drop("band")
    shared = other(flat.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band"))
    shared = stored(other(flat).join(shared, "bucket"))
    places = shared.count()
    members = shared.join(shared.groupBy("bucket").agg(F.min("key").alias("head")), "bucket")
    stars = stored(members.where("key <> head").select(F.col("head").alias("src"), F.col("key").alias("dst")).distinct(), places)
    ids = stars.select("src").union(stars.select("dst")).distinct().withColumnRenamed("src", "id_")
    chosen = stored(reps.join(ids, F.col("key") == F.col("id_"), "left_semi").select(F.col("id").alias("own"), F.col("raw").alias("raw_")), places)
    few = small_or_none(chosen, SMALL)
    wanted = docs.select(F.col(id_col).alias("id"), raw_key(F.col(text_col)).alias("raw"), F.col(text_col).alias("text"))
    wanted = wanted.join(few if few is not None else chosen, (F.col("raw") == F.col("raw_")) & F.col("id").eqNullSafe(F.col("own")), "left_semi")
    sets = stored(shingled(wanted, counts).groupBy("key").agg(F.first("s").alias("s")))
    links = stored(_verified(stars, sets, similarity))
    release(stars, chosen)
    found = connected_components(links)
    release(links)
    joined = lambda classes: classes.select(F.col("component").alias("src"), F.col("node").alias("dst"))  # noqa: E731  # in the links' stead: fewer, and paths are short
    # Buckets whose members the links so far leave in several components: the smaller components' members meet one
    # member of the largest, another one every round, as long as that joins components.
    before = None
    for turn in range(HUB_ROUNDS + 1):
        placed = stored(shared.join(found.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("part")), places)
        by_part = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.min_by("key", F.xxhash64("key", F.lit(turn))).alias("hub"))
        split = by_part.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by(F.struct("part", "hub"), F.struct("n", "part")).alias("main")).where("parts > 1")
        split = stored(split.select(F.reverse(F.col("bucket").cast("string")).alias("b"), F.col("main.part").alias("main"), "main.hub", "all", (F.col("all") - F.col("most")).alias("few")), places)
        pairs, rows_left = split.agg(F.sum(F.expr("few * all")), F.sum("all")).first()
        if not pairs:
            return found.select(F.col("node").alias("key"), F.col("component").alias("class"))
        apart = placed.withColumn("b", F.reverse(F.col("bucket").cast("string"))).join(split, "b").select("b", "key", "part", "main", "hub", "all", "few")
        if pairs <= FEW_PAIRS * rows_left or turn == HUB_ROUNDS or before and pairs > 0.7 * before:
            break
        before = pairs
        tried = stored(apart.where("part <> main").select(F.least("hub", "key").alias("src"), F.greatest("hub", "key").alias("dst")).distinct(), places)
        links = stored(joined(found).union(_verified(tried, sets, similarity)))
        release(tried, placed, split, found)
        found = connected_components(links)
        release(links)
    apart = stored(apart, rows_left)
    release(placed, split)
    rest = stored(_likely(apart, sets, reps, similarity, min(PASSES, 1 + rows_left // PASS)).distinct())
    links = stored(joined(found).union(_verified(rest, sets, similarity)))
    release(apart, rest, found)
    found = connected_components(links)
    release(links)
    return found.select(F.col("node").alias("key"), F.col("component").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """(id_col, class_id, kept) for every row: class_id is the smallest id of its class, kept whether it is the row's own."""
    rows = stored(signed(docs, id_col, text_col, counts))
    classes = near_classes(docs, rows, id_col, text_col, counts)
    named = stored(rows.groupBy("key").agg(F.min("id").alias("least")).join(classes, "key", "left").select("key", "least", F.coalesce("class", "key").alias("class")))
    heads = named.groupBy("class").agg(F.min("least").alias("class_id"))
    final = named.select("key", F.reverse("class").alias("by")).join(heads.withColumn("by", F.reverse("class")).drop("class"), "by").select(F.reverse("key").alias("turned"), "class_id")
    keyed = rows.select("id", F.reverse("key").alias("turned"))
    return keyed.join(final, "turned").select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """The documents that stay: of every class the row with the smallest id, its smallest text and only once."""
    rows = stored(signed(docs, id_col, text_col, counts))
    classes = near_classes(docs, rows, id_col, text_col, counts)
    named = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull(), "id", "key", "raw")).alias("m")).join(classes, "key", "left")
    stay = named.groupBy(F.coalesce("class", "key")).agg(F.min("m").alias("m")).select(F.col("m.id").alias("stay_id"), F.col("m.raw").alias("stay_raw"))
    raw = fresh(docs, "raw_key")
    found = docs.withColumn(raw, raw_key(F.col(text_col))).join(stored(stay), (F.col(raw) == F.col("stay_raw")) & F.col(id_col).eqNullSafe(F.col("stay_id")), "left_semi")
    return found.dropDuplicates([id_col, raw]).select(*docs.columns)
