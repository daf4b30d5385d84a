"""Byte-pair encoding in batched numpy merge rounds, and decoding.

``Codec`` reads a vocabulary file of the tokenizers library (NFC, white space folded, lower case, words split by the
file's pattern, bytes as letters, an end mark on every word).  Encoding puts the symbols of all new words of a batch in
one flat array; each round looks up every neighbouring pair by binary search over the sorted pair keys, finds the
lowest rank of each word and merges its pairs from left to right, until no word has a known pair.  Runs between blanks
that the task has seen before come from a table of bounded bytes, which is dropped when the task ends.

Defined results: a null text is an empty text and has no tokens; texts are encoded whole, whatever their length;
special tokens' strings inside a text become those tokens, as in the library.  Rows are encoded one by one: repeated rows
give repeated results, an empty table gives no rows, columns that aren't asked for are left out.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import byte_slices

#: Bytes of runs between blanks that a task remembers; beyond them the table starts anew.
REMEMBERED = 1 << 26
#: A remembered run's bytes besides its letters.
ENTRY = 160
#: Bytes of texts that are encoded together, and ids that are decoded together.
SLICE, TOKENS = 1 << 20, 1 << 18
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next of U+0100 and after."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class Codec:
    """One vocabulary file's encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.size = max(names) + 1
        self.tokens = [names.get(i, "") for i in range(self.size)]
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace("\\s", _SPACE))
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.separators = [chr(i) for i in range(0x1C, 0x20)]  # blanks to str.split(), not to the library
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()
        self.digits = Pieces([f"{i} ".encode() for i in range(self.size)])
        self.spelled = Pieces([f"{t} ".encode() for t in self.tokens])

    def forget(self) -> None:
        """Start with an empty table: a lower-case run without blanks -> its place in starts, sizes."""
        self.known: dict[str, int] = {}
        self.flat, self.sizes, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def runs(self, text: str) -> list[str]:
        """The runs of a text between blanks, in lower case; special tokens stay whole."""
        if self.marks is not None and "<|" in text and self.marks.search(text):
            return list(chain.from_iterable([part] if part in self.special else self._runs(part) for part in self.marks.split(text)))
        return self._runs(text)

    def _runs(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [r for r in self.spaces.split(text) if r] if any(x in text for x in self.separators) else text.split()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs by binary search over the sorted keys (unknown pairs: the number of merges), and their places."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys)), at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and each word's number of tokens, by merge rounds over all at once."""
        data = [w.encode() for w in words]
        sizes = np.array([len(x) for x in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        none = len(self.keys)
        rank, place = self.pair_ranks(symbols, np.append(symbols[1:], 0))  # of each symbol with the next
        rank[ends - 1] = none
        done_symbols, done_words = [], []
        while True:
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(heads, len(symbols)))
            lowest = np.minimum.reduceat(rank, heads)
            keep = np.repeat(lowest < none, lengths)
            if not keep.all():
                done_symbols.append(symbols[~keep])
                done_words.append(word[~keep])
                symbols, word, rank, place = symbols[keep], word[keep], rank[keep], place[keep]
                lowest, lengths = lowest[lowest < none], lengths[lowest < none]
            if not len(symbols):
                break
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            fresh = np.concatenate(([True], np.diff(hit) > 1))  # of pairs that overlap, as in "aaa", every second one from the left
            hit = hit[(hit - hit[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]) % 2 == 0]
            symbols[hit] = self.made[place[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep)[hit] - 1
            symbols, word, place = symbols[keep], word[keep], place[keep]
            rank[hit] = rank[hit + 1]  # so that the end of a word stays one
            rank = rank[keep]
            near = np.zeros(len(symbols), bool)
            near[moved], near[np.maximum(moved - 1, 0)] = True, True
            touched = np.flatnonzero(near)
            inner = touched[touched < len(symbols) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[touched] = none
            rank[inner], place[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        return flat[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))

    def learn(self, runs: list[str]) -> None:
        """Put new runs into the table: each is split into words, all distinct words are merged at once."""
        words = [[r] if r.isalpha() or r in self.special else self.words.findall(r) for r in runs]
        flat_words = list(chain.from_iterable(words))
        place = {w: i for i, w in enumerate(dict.fromkeys(flat_words))}
        if not place:
            ids, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        else:
            ids, sizes = self.merge(list(place))
        for w, i in self.special.items():
            if w in place:
                at, end = int(sizes[: place[w]].sum()), int(sizes[: place[w] + 1].sum())
                ids, sizes[place[w]] = np.concatenate((ids[:at], np.array([i], np.int32), ids[end:])), 1
        which = np.fromiter(map(place.__getitem__, flat_words), np.int64, len(flat_words))
        size = sizes[which]
        ends = np.cumsum(size)
        source = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - size), size)
        source += np.arange(len(source))
        of_run = np.cumsum([0, *map(len, words)])
        self.known.update(zip(runs, range(len(self.sizes), len(self.sizes) + len(runs)), strict=True))
        self.flat = np.concatenate((self.flat, ids[source]))
        self.sizes = np.concatenate((self.sizes, np.diff(np.concatenate(([0], ends))[of_run])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and each text's number of tokens."""
        split = [self.runs(t) for t in texts]
        runs = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(runs[i] for i in missing.tolist()))
            if self.held > REMEMBERED:
                self.forget()
                new, missing = list(dict.fromkeys(runs)), np.arange(len(runs))
            self.learn(new)
            self.held += sum(map(len, new)) + ENTRY * len(new)
            at[missing] = np.fromiter((self.known[runs[i]] for i in missing.tolist()), np.int64, len(missing))
        size = self.sizes[at]
        ends = np.cumsum(size)
        source = np.repeat((np.cumsum(self.sizes) - self.sizes)[at] - (ends - size), size)
        source += np.arange(len(source))
        of_text = np.cumsum([0, *map(len, split)])
        return self.flat[source], np.diff(np.concatenate(([0], ends))[of_text])

    def ids_text(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's decimal ids joined by blanks."""
        return self.digits.joined(ids, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's tokens joined by blanks, as the library decodes without a decoder, in UTF-8."""
        return self.spelled.joined(ids, counts)


class Pieces:
    """Byte strings that end in a blank, gathered by number."""

    def __init__(self, pieces: list[bytes]):
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size)
        at += np.arange(len(at))
        flat = self.raw[at].tobytes()
        ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The process's codec of a file."""
    return Codec(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' package has a file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _counted(counts: np.ndarray):
    """(first, after last) of runs of texts of bounded ids together."""
    ends, a = np.cumsum(counts + 1), 0
    while a < len(counts):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
        yield a, z
        a = z


def _digests(c: Codec, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    return [hashlib.sha256(x).hexdigest() for x in c.ids_text(ids, counts)]


def encode_texts(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = "word_bpe_49k.json", ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and each text's token ids as array<int>.  No shuffle."""
    types = [df.schema[c] for c in keep]
    source = df.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    out = ", ".join(["ids array<int>", *(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(types))])

    def run(batches):
        c = codec(vocabulary_path(vocabulary))
        for b in byte_slices(batches, 0, SLICE):
            ids, counts = c.encode([t or "" for t in b.column(0).to_pylist()])
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([rows, *b.columns[1:]], ["ids", *(f"k{i}" for i in range(len(keep)))])
        c.forget()

    done = source.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(ids_col))


def decode_ids(df: DataFrame, ids_col: str, keep: list[str], vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """The columns ``keep``, n_tokens, ids_sha256 of the decimal ids, and the decoded text.  Null ids count as none."""
    types = [df.schema[c] for c in keep]
    source = df.select(F.col(ids_col).alias("ids"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    out = ", ".join(["n_tokens bigint, ids_sha256 string, decoded string", *(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(types))])

    def run(batches):
        c = codec(vocabulary_path(vocabulary))
        for b in batches:
            lists = b.column(0).fill_null([]) if b.column(0).null_count else b.column(0)
            counts = np.diff(lists.offsets.to_numpy())
            first = lists.offsets[0].as_py() if len(lists) else 0
            values = lists.values.to_numpy(zero_copy_only=False)[first:]
            starts = np.concatenate(([0], np.cumsum(counts)))
            for lo, hi in _counted(counts):
                ids = values[starts[lo] : starts[hi]]
                decoded = pa.array(c.decode(ids, counts[lo:hi]), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(counts[lo:hi], pa.int64()), pa.array(_digests(c, ids, counts[lo:hi]), pa.string()), decoded, *(x.slice(lo, hi - lo) for x in b.columns[1:])], ["n_tokens", "ids_sha256", "decoded", *(f"k{i}" for i in range(len(keep)))])

    done = source.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids_sha256", "decoded")


def round_trip(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """The columns ``keep``, n_tokens, ids_sha256 and decoded_sha256: ``encode_texts`` and ``decode_ids`` of every text in
    one pass, so that neither ids nor decoded texts leave the task."""
    types = [df.schema[c] for c in keep]
    source = df.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    out = ", ".join(["n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(types))])

    def run(batches):
        c = codec(vocabulary_path(vocabulary))
        for b in byte_slices(batches, 0, SLICE):
            ids, counts = c.encode([t or "" for t in b.column(0).to_pylist()])
            decoded = [hashlib.sha256(x).hexdigest() for x in c.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(_digests(c, ids, counts), pa.string()), pa.array(decoded, pa.string()), *b.columns[1:]], ["n_tokens", "ids_sha256", "decoded_sha256", *(f"k{i}" for i in range(len(keep)))])
        c.forget()

    done = source.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document: encoded, then decoded from the ids."""
    return round_trip(docs, "text", ["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
