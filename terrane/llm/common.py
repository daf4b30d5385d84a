"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from terrane.operators.graph import min_labels
from terrane.sources.tables import release, shared_dir, stored, table

__all__ = ["byte_slices", "connected_components", "fresh", "mix", "release", "shared_dir", "small_or_none", "stored", "string_hashes", "table", "unsliced"]

#: Bytes up to which strings are hashed many at once.
LONG_WORD = 128
GOLDEN, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x + GOLDEN
    for shift, factor in ((30, M1), (27, M2)):
        x ^= x >> np.uint64(shift)
        x *= factor
    x ^= x >> np.uint64(31)
    return x


def string_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings without nulls, eight bytes of all of them at a time."""
    words = unsliced(words.cast(pa.large_string()))
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = (data.to_pybytes() if data else b"") + bytes(8)
    start, size = offsets[:-1], np.diff(offsets)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the eight bytes from each byte on
    h = mix(size.astype(np.uint64))
    for j in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
        on = np.flatnonzero(size > j)
        left = np.minimum(size[on] - j, 8).astype(np.uint64)
        h[on] = mix(h[on] ^ (eight[start[on] + j] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return h


def byte_slices(batches, column: int = 0, most: int = 1 << 21, rows: int = 2048):
    """The batches in slices of at most ``most`` bytes in a text column and ``rows`` rows; a longer text is a slice of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            z = min(z, a + rows)
            yield b.slice(a, z - a)
            a = z
            pa.default_memory_pool().release_unused()  # so that a worker between tasks holds little


def unsliced(values: pa.Array) -> pa.Array:
    """A copy that starts at offset 0: some string kernels read slices from the wrong place."""
    return values.take(pa.array(np.arange(len(values))))


def small_or_none(df: DataFrame, most: int) -> DataFrame | None:
    """``df`` marked for broadcast if it has at most ``most`` rows; else None, for the caller's shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else None


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph with the edges (src, dst), as (node, component), component being the smallest
    node.  Nodes without an edge don't appear."""
    return min_labels(edges)
