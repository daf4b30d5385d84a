"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

A vector's entries c become the integers x = floor(256 c).  The fit list holds every different x once; its number n, its
sums S and its products are summed exactly by tasks and by Spark, which gives the integer scatter C = n sum(x x') - S S',
n^2 times the covariance.  C's characteristic polynomial is found modulo many primes, dealt to tasks in blocks: each
reduces C to Hessenberg form modulo its primes and reads the polynomial off it.  Coefficients are put together by Chinese
remaindering, one group a coefficient.  All roots are real and none is negative, so that the number of sign changes of
the polynomial shifted by a is the number of eigenvalues above a: halving intervals by it isolates the largest roots to
``BITS`` bits, multiple ones included.  Components span the null space of C minus a root, by inverse iteration in fixed
point of as many bits.

Vectors of different lengths are fitted apart.  A fit's matrix is in one task (d^2 numbers of the vectors' length d, no
rows); work grows with d^3 times the primes, which grow with d.

Defined results: vectors that are null, or hold entries that are null, not finite or so large that x is no long, have no
rows, nor have vectors without entries; repeated rows have rows each and count once in the fit; null ids stay; a
component without variance has a null ``whitened`` and explains 0 (null if no component has variance); ``deviation`` is
a decimal, null beyond 38 digits; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import release, stored

#: Components of a row, entries' scale, bits of roots and of the fixed point, bits of a limb, primes of a block.
COMPONENTS, SCALE, BITS, LIMB, PRIMES = 4, 256, 192, 20, 16
#: Entries that are looked at together.
VALUES = 1 << 20
_HALF = 60  # bits of a sum's lower part: a decimal holds sums of both parts


# --- integer vectors ---------------------------------------------------------------------------------------------------


def integer_vectors(lists: pa.Array):
    """(rows, x): row numbers and integers (m, d) of the vectors that can be used, by length, in slices."""
    values = np.asarray(lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # null entries: NaN
    offsets = lists.offsets.to_numpy()
    ok, length = np.asarray(lists.is_valid()), np.diff(offsets)
    for d in np.unique(length[ok & (length > 0)]).tolist():
        rows = np.flatnonzero(ok & (length == d))
        step = max(1, VALUES // d)
        for a in range(0, len(rows), step):
            at = rows[a : a + step]
            x = np.floor(values[offsets[at][:, None] + np.arange(d)] * SCALE)
            fit = (np.abs(x) < 2.0**63).all(axis=1)  # false for NaN and infinite entries
            yield at[fit], x[fit].astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """A vector's bytes: how many each entry takes, then the entries; equal vectors have equal bytes."""
    most = np.abs(x).max(axis=1, initial=0)
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        data, size, head = x[rows].astype(f"<i{w}").tobytes(), x.shape[1] * w, bytes([w])
        for k, r in enumerate(rows.tolist()):
            out[r] = head + data[k * size : (k + 1) * size]
    return out


def unpacked(rows: list[bytes]):
    """(d, x) of ``packed`` vectors, by width and length."""
    kinds: dict[tuple[int, int], list[bytes]] = {}
    for r in rows:
        kinds.setdefault((r[0], (len(r) - 1) // r[0]), []).append(r[1:])
    for (w, d), some in sorted(kinds.items()):
        step = max(1, VALUES // d)
        for a in range(0, len(some), step):
            yield d, np.frombuffer(b"".join(some[a : a + step]), f"<i{w}").reshape(-1, d).astype(np.int64)


def products(x: np.ndarray) -> np.ndarray:
    """x'x as exact integers: by blocks of rows whose products of limbs stay below 2^53."""
    whole = int(np.abs(x).max(initial=0)) < 1 << LIMB
    limbs = [(0, x)] if whole else [(s, x >> s if s == 3 * LIMB else (x >> s) & ((1 << LIMB) - 1)) for s in range(0, 4 * LIMB, LIMB)]
    out = np.zeros((x.shape[1],) * 2, object)
    for a in range(0, len(x), 4096):
        for s, p in limbs:
            for t, q in limbs:
                part = (p[a : a + 4096].T.astype(float) @ q[a : a + 4096].astype(float)).astype(np.int64).astype(object)
                out += part << (s + t) if s + t else part
    return out


def _moments(batches):
    """(d, i, j, high, low): i = j = -1 the number of vectors, i = -1 their sums, else i <= j their products."""
    sums: dict[int, list] = {}
    for b in batches:
        for d, x in unpacked(b.column(0).to_pylist()):
            n, s, m = sums.get(d) or (0, 0, 0)
            low = (x & ((1 << 32) - 1)).sum(axis=0).astype(object) + ((x >> 32).sum(axis=0).astype(object) << 32)
            sums[d] = [n + len(x), s + low, m + products(x)]
    for d, (n, s, m) in sums.items():
        i, j = np.triu_indices(d)
        cells = [(-1, -1, n), *((-1, k, v) for k, v in enumerate(s)), *zip(i.tolist(), j.tolist(), m[i, j], strict=True)]
        for a in range(0, len(cells), 1 << 16):
            some = cells[a : a + (1 << 16)]
            parts = [[Decimal(f(int(c[2]))) for c in some] for f in (lambda v: v >> _HALF, lambda v: v & ((1 << _HALF) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(some), pa.int32()), *(pa.array([c[k] for c in some], pa.int32()) for k in (0, 1)), *(pa.array(p, pa.decimal128(38, 0)) for p in parts)], ["d", "i", "j", "high", "low"])


def _texts(numbers) -> str:
    return " ".join(map(str, numbers))


def _gathered(t: pa.Table) -> pa.Table:
    """One row a length: n, S, the scatter's upper triangle, and the blocks of primes that its polynomial needs."""
    cells = {(i, j): (int(h) << _HALF) + int(v) for i, j, h, v in zip(*(t.column(c).to_pylist() for c in ("i", "j", "high", "low")), strict=True)}
    d, n = t.column("d")[0].as_py(), cells[-1, -1]
    s = [cells[-1, k] for k in range(d)]
    scatter = [n * cells[i, j] - s[i] * s[j] for i in range(d) for j in range(i, d)]
    # a coefficient is a sum of products of k eigenvalues, at most C(d, k) (trace / d)^k
    trace = sum(n * cells[i, i] - s[i] ** 2 for i in range(d))
    bits = d + d * max(0, (-(-trace // d)).bit_length()) + 2
    return pa.table({"d": pa.array([d], pa.int32()), "n": [n], "sums": [_texts(s)], "scatter": [_texts(scatter)], "blocks": pa.array([-(-(bits // 30 + 1) // PRIMES)], pa.int32())})


def square(d: int, text: str) -> np.ndarray:
    """The symmetric matrix of integers whose upper triangle the text holds."""
    out = np.zeros((d, d), object)
    i, j = np.triu_indices(d)
    out[i, j] = out[j, i] = np.array([int(v) for v in text.split()], object)
    return out


# --- the polynomial modulo primes --------------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Exact below 2^32 with these bases."""
    if n % 2 == 0:
        return n == 2
    s = (n - 1 & -(n - 1)).bit_length() - 1
    for base in (2, 7, 61):
        x = pow(base, (n - 1) >> s, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


@lru_cache(4)
def primes(many: int) -> tuple[int, ...]:
    """The largest ``many`` primes below 2^31: each has more than 30 bits."""
    out, n = [], (1 << 31) - 1
    while len(out) < many:
        if is_prime(n):
            out.append(n)
        n -= 2
    return tuple(out)


def polynomials(c: np.ndarray, moduli: tuple[int, ...]) -> np.ndarray:
    """Coefficients (primes, d + 1), from the constant on, of det(xI - C) modulo each prime."""
    d, p = len(c), np.array(moduli, np.int64)
    h = np.stack([(c % m).astype(np.int64) for m in moduli])
    every = np.arange(len(p))
    inverse = lambda v: np.array([pow(int(a), -1, int(m)) if a else 0 for a, m in zip(v, p, strict=True)], np.int64)
    for k in range(1, d - 1):  # to Hessenberg form: clear column k - 1 below row k
        at = k + (h[:, k:, k - 1] != 0).argmax(axis=1)
        h[every, at], h[:, k] = h[:, k].copy(), h[every, at]
        h[every, :, at], h[:, :, k] = h[:, :, k].copy(), h[every, :, at]
        f = h[:, k + 1 :, k - 1] * inverse(h[:, k, k - 1])[:, None] % p[:, None]
        h[:, k + 1 :] = (h[:, k + 1 :] - f[:, :, None] * h[:, k, None, :] % p[:, None, None]) % p[:, None, None]
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1 :] * f[:, None, :] % p[:, None, None]).sum(axis=2)) % p[:, None]
    q = np.zeros((d + 1, len(p), d + 1), np.int64)  # of the leading minors
    q[0, :, 0] = 1
    for m in range(1, d + 1):
        q[m, :, 1:] = q[m - 1, :, :-1]
        q[m] -= h[:, m - 1, m - 1, None] * q[m - 1] % p[:, None]
        below = np.ones(len(p), np.int64)
        for i in range(m - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            q[m] -= (below * h[:, i - 1, m - 1] % p)[:, None] * q[i - 1] % p[:, None]
        q[m] %= p[:, None]
    return q[d]


def _residues(batches):
    """(d, k, p, c) of (d, scatter, block)."""
    for b in batches:
        for d, text, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = primes((block + 1) * PRIMES)[block * PRIMES :]
            c = polynomials(square(d, text), own)
            cells = np.broadcast_to(np.arange(d + 1), c.shape).ravel(), np.repeat(own, d + 1), c.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(c.size, d), pa.int32()), pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.int64())], ["d", "k", "p", "c"])


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these remainders."""
    value, whole = 0, 1
    for r, p in sorted(zip(residues, moduli, strict=True), key=lambda x: -x[1]):
        value += whole * ((r - value) * pow(whole, -1, p) % p)
        whole *= p
    return value - whole if 2 * value > whole else value


def _coefficients(t: pa.Table) -> pa.Table:
    value = remaindered(t.column("c").to_pylist(), t.column("p").to_pylist())
    return pa.table({"d": t.column("d")[:1], "k": t.column("k")[:1], "coefficient": [str(value)]})


# --- roots and components ----------------------------------------------------------------------------------------------


def roots_above(c: list[int], m: int, s: int) -> int:
    """How many roots of a polynomial with real roots only are above m / 2^s: the sign changes after a shift."""
    scaled = c
    if m:
        power, scaled = 1, []
        for k, v in enumerate(c):  # 2^(s d) p(m y / 2^s)
            scaled.append((v * power) << s * (len(c) - 1 - k))
            power *= m
        row = np.array(scaled[::-1], object)
        for k in range(len(row), 1, -1):  # y to y + 1: running sums, each one shorter
            row[:k] = np.cumsum(row[:k])
        scaled = row.tolist()
    signs = [v > 0 for v in scaled if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(c: list[int], top: int, most: int) -> list[int]:
    """The up to ``most`` largest positive roots, multiple ones repeated, in units of 2^(top - BITS), none above 2^top."""
    found: list[int] = []
    todo = [(0, 0, roots_above(c, 0, 0), 0)]  # place, level, roots above its lower and its upper end: the last is next
    while todo and len(found) < most:
        place, level, low, high = todo.pop()
        if level == BITS:
            found += [place] * (low - high)
        elif low - high == 1:  # isolated: halve by the polynomial's sign, which is (-1)^high between this root and the next
            while level < BITS:
                level, place = level + 1, 2 * place
                place += _horner(c, *_point(place + 1, level, top)) * (-1) ** high < 0
            found.append(place)
        elif low > high:
            mid = roots_above(c, *_point(2 * place + 1, level + 1, top))
            todo += [(2 * place, level + 1, low, mid), (2 * place + 1, level + 1, mid, high)]
    return found[:most]


def _point(m: int, level: int, top: int) -> tuple[int, int]:
    """m 2^(top - level) as (m', s): m' / 2^s."""
    return (m << top - level, 0) if top >= level else (m, level - top)


def _horner(c: list[int], m: int, s: int) -> int:
    """2^(s d) p(m / 2^s)."""
    out = 0
    for k, v in enumerate(reversed(c)):
        out = out * m + (v << s * k)
    return out


def null_vector(a: np.ndarray, root: int, known: list[np.ndarray], seed: int) -> np.ndarray:
    """An integer vector of about BITS bits in the null space of A - root, orthogonal to ``known``; A in units of 2^-BITS."""
    d, m = len(a), a.copy()
    m[np.arange(d), np.arange(d)] -= root
    order = []
    for k in range(d):
        at = k + max(range(d - k), key=lambda r: abs(m[k + r, k]))
        order.append(at)
        if at != k:
            m[[k, at]] = m[[at, k]]
        if not m[k, k]:
            m[k, k] = 1
        if k + 1 < d:
            m[k + 1 :, k] = np.array([(int(v) << BITS) // int(m[k, k]) for v in m[k + 1 :, k]], object)
            m[k + 1 :, k + 1 :] -= (m[k + 1 :, k, None] * m[k, k + 1 :]) >> BITS
    rng = random.Random(seed)
    x = np.array([rng.getrandbits(BITS) - (1 << BITS - 1) for _ in range(d)], object)
    for _ in range(3):
        x = _apart(x, known)
        for k, at in enumerate(order):
            if at != k:
                x[[k, at]] = x[[at, k]]
        for k in range(d - 1):
            x[k + 1 :] -= (m[k + 1 :, k] * x[k]) >> BITS
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] - (int((m[k, k + 1 :] * x[k + 1 :]).sum()) >> BITS if k + 1 < d else 0)) << BITS) // m[k, k]
    return _apart(x, known)


def _apart(x: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """x without its parts along ``known``, at BITS bits."""
    for w in known:
        x = x - np.array([v * int((x * w).sum()) // int((w * w).sum()) for v in w], object)
    shift = int(max(abs(v) for v in x)).bit_length() - BITS
    return np.array([int(v) >> shift if shift > 0 else int(v) << -shift for v in x], object)


@dataclass(frozen=True)
class Model:
    """n and sums of a fit, and per component its direction, eigenvalue (of the covariance of x) and share of the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: list[float | None]

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list | np.ndarray]:
        """Whitened rows (m, components), NaN without variance, and exact deviations."""
        most, s = int(np.abs(x).max(initial=0)), max((abs(v) for v in self.sums), default=0)
        bound = self.n * most + s
        if bound < 1 << 62:
            z = x * self.n - np.array(self.sums, np.int64)
        else:
            z = x.astype(object) * self.n - np.array(self.sums, object)
        small = len(self.sums) * bound * bound < 1 << 63
        deviations = (z * z).sum(axis=1) if small else (z.astype(object) ** 2).sum(axis=1)
        centred = z.astype(float) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            out = centred @ self.directions.T / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out, deviations


def model_of(d: int, n: int, sums: str, scatter: str, coefficients: list[str], components: int) -> dict:
    """The largest components of a scatter whose characteristic polynomial's coefficients are given."""
    c, a = [int(v) for v in coefficients], square(d, scatter)
    trace = int(a[np.arange(d), np.arange(d)].sum())
    while not c[0] and len(c) > 1:
        c = c[1:]
    top, many = max(trace, 1).bit_length(), min(components, d)
    roots = largest_roots(c, top, many) if len(c) > 1 else []
    fixed, known = (a << BITS) >> top, []
    for k, root in enumerate(roots):
        known.append(null_vector(fixed, root, known, k))
    directions, values = np.zeros((many, d)), np.zeros(many)
    for k, (root, v) in enumerate(zip(roots, known, strict=True)):
        size = math.isqrt(int((v * v).sum()))
        u = np.array([int(e) / size for e in v])
        directions[k] = u * np.sign(u[np.abs(u).argmax()])
        values[k] = (root << top) / (n * n << BITS)
    explained = [(roots[k] << top) / (trace << BITS) if k < len(roots) else (0.0 if trace else None) for k in range(many)]
    return {"d": d, "n": n, "sums": sums, "directions": directions.ravel().tolist(), "eigenvalues": values.tolist(), "explained": explained}


def _models(batches, components):
    names = {"d": pa.int32(), "n": pa.int64(), "sums": pa.string(), "directions": pa.list_(pa.float64()), "eigenvalues": pa.list_(pa.float64()), "explained": pa.list_(pa.float64())}
    for b in batches:
        rows = [model_of(*r, components) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in names.items()], list(names))


# --- on Spark ----------------------------------------------------------------------------------------------------------


def fit_list(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(x) every different integer vector once, packed."""

    def run(batches):
        for b in batches:
            for _, x in integer_vectors(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], ["x"])

    return df.select(vector_col).mapInArrow(run, "x binary").distinct()


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The models of a fit list by length; the driver gets d numbers for each component and no rows of the data."""
    sums = fit.mapInArrow(_moments, "d int, i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low"))
    matrix = stored(sums.groupBy("d").applyInArrow(_gathered, "d int, n bigint, sums string, scatter string, blocks int"))
    blocks = matrix.select("d", "scatter", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    residues = blocks.repartition("d", "block").mapInArrow(_residues, "d int, k int, p bigint, c bigint")
    coefficients = residues.groupBy("d", "k").applyInArrow(_coefficients, "d int, k int, coefficient string")
    whole = coefficients.groupBy("d").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "coefficient"))), lambda v: v["coefficient"]).alias("coefficients"))  # d + 1 rows each
    joined = matrix.join(whole, "d").select("d", "n", "sums", "scatter", "coefficients")
    table = joined.mapInArrow(lambda batches: _models(batches, components), "d int, n bigint, sums string, directions array<double>, eigenvalues array<double>, explained array<double>")
    out = {}
    for r in table.collect():
        out[r["d"]] = Model(r["n"], [int(v) for v in r["sums"].split()], np.array(r["directions"]).reshape(-1, r["d"]), np.array(r["eigenvalues"]), r["explained"])
    release(matrix)
    return out


def identity_error(fit: DataFrame, by_length: dict[int, Model]) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured on the list.

    Tasks centre their vectors before multiplying them; means and products of tasks are put together by their sizes.
    """

    def run(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for d, x in unpacked(b.column(0).to_pylist()):
                w = by_length[d].whiten(x)[0]
                w = w[:, ~np.isnan(w).all(axis=0)]
                n, mean, c = sums.get(d) or (0, np.zeros(w.shape[1]), np.zeros((w.shape[1],) * 2))
                own, apart = w.mean(axis=0), w - w.mean(axis=0)
                step, every = own - mean, n + len(w)
                sums[d] = [every, mean + step * len(w) / every, c + apart.T @ apart + np.outer(step, step) * (n * len(w) / every)]
        for d, (n, mean, c) in sums.items():
            i, j = np.triu_indices(len(mean))
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([n] * len(i), pa.int64()), pa.array(mean[i]), pa.array(mean[j]), pa.array(c[i, j])], ["d", "i", "j", "n", "a", "b", "c"])

    parts = fit.mapInArrow(run, "d int, i int, j int, n bigint, a double, b double, c double")
    n = F.sum("n")
    whole = parts.groupBy("d", "i", "j").agg((F.sum(F.col("c") + F.col("n") * F.col("a") * F.col("b")) / n - F.sum(F.col("n") * F.col("a")) / n * (F.sum(F.col("n") * F.col("b")) / n)).alias("v"))
    return whole.agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whitened(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(<id>, component, n, deviation decimal, whitened, explained, identity_error) of every usable vector."""
    fit = stored(fit_list(df, vector_col))
    by_length = fitted(fit, components)
    error = identity_error(fit, by_length) if by_length else None
    release(fit)
    types = {"component": pa.int32(), "n": pa.int64(), "deviation": pa.decimal128(38, 0), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}

    def run(batches):
        for b in batches:
            for rows, x in integer_vectors(b.column(1)):
                if not len(rows):
                    continue
                m = by_length[x.shape[1]]
                w, deviations = m.whiten(x)
                k = min(components, w.shape[1])
                if deviations.dtype == object:
                    exact = pa.array([Decimal(int(v)) if v < 10**38 else None for v in deviations], types["deviation"])
                else:
                    exact = pa.array(deviations).cast(types["deviation"])
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                columns = [
                    b.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), len(rows)), types["component"]), pa.array(np.full(len(each), m.n), pa.int64()), exact.take(each),
                    pa.array(w[:, :k].ravel(), pa.float64(), from_pandas=True), pa.array(m.explained[:k] * len(rows), pa.float64()), pa.array(np.full(len(each), error, float), pa.float64(), from_pandas=True),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", *types])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), vector_col).mapInArrow(run, f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)


def whitening_digest(df: DataFrame) -> DataFrame:
    """``whitened`` with the deviation as a long, null beyond its range."""
    return whitened(df).withColumn("deviation", F.col("deviation").try_cast("bigint"))
