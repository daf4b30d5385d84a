"""Media columns: baseline JPEG files written and read in numpy.

``write_media`` stores bytes losslessly as the quantised coefficients of 8 x 8 blocks: a byte is a coefficient from
-128 to 127, 64 bytes are a block, every block is a restart interval.  ``read_media`` parses the markers of baseline
files (one interleaved scan, any sampling factors, any restart interval), Huffman-decodes all restart intervals of a
batch in lockstep, and reconstructs DC-only thumbnails of the luminance.

Defined results: a null text counts as empty; an empty text is one block of zeros; null media give nulls; a file that
isn't a baseline JPEG raises ValueError.  Rows are handled one batch at a time in slices of bounded bytes, whatever
their order, and repeated rows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import byte_slices

#: Bytes of payload that are coded together; bounds the memory of a task.
SLICE = 1 << 20
#: Bytes of a payload, and of a scan, that are coded or read at once.
PIECE = 1 << 20

# Fixed values of the baseline format: the zigzag order isn't needed, as coefficients are stored in scan order.
#: Huffman tables of the writer: counts of codes by length 1 to 16, then symbols.  Letters are size 7, blanks and
#: punctuation size 6, line ends size 4; all other AC symbols share codes of 13 bits.
DC_BITS, DC_SYMBOLS = [1] * 9 + [0] * 7, [7, 6, 5, 0, 4, 8, 3, 2, 1]
AC_FIRST = [0x07, 0x06, 0x00, 0x04, 0x05]
AC_SYMBOLS = AC_FIRST + [s for s in [0xF0, *(r << 4 | z for r in range(16) for z in range(1, 11))] if s not in AC_FIRST]
AC_BITS = [1] * 5 + [0] * 7 + [len(AC_SYMBOLS) - 5] + [0] * 3


def _codes(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    _segment(0xDB, b"\0" + b"\1" * 64),
    _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_SYMBOLS)) + _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_SYMBOLS)) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0"),
)


def _value_luts() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code bits followed by value bits, and their lengths: for DC by value + 128, for AC by run and value + 128."""
    dc, ac = _codes(DC_BITS, DC_SYMBOLS), _codes(AC_BITS, AC_SYMBOLS)
    dcv, dcl, acv, acl = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(4096, np.int64), np.zeros(4096, np.int64)
    for v in range(-128, 128):
        size = abs(v).bit_length()
        extra = v if v > 0 else v + (1 << size) - 1
        code, n = dc[size]
        dcv[v + 128], dcl[v + 128] = code << size | extra, n + size
        for run in range(16) if v else ():
            code, n = ac[run << 4 | size]
            acv[run * 256 + v + 128], acl[run * 256 + v + 128] = code << size | extra, n + size
    return dcv, dcl, acv, acl


_DCV, _DCL, _ACV, _ACL = _value_luts()
_DCL, _ACL = _DCL.astype(np.int32), _ACL.astype(np.int32)
_EOB, _ZRL = _codes(AC_BITS, AC_SYMBOLS)[0], _codes(AC_BITS, AC_SYMBOLS)[0xF0]


def _scans(blocks: np.ndarray, last: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n, 64), and where each block's bytes end.

    last: whether a block ends its image; nth: its number within the image, for the restart markers.
    """
    n = len(blocks)
    mask = blocks != 0
    mask[:, 0] = False
    flat = np.flatnonzero(mask.ravel()).astype(np.int32)
    row, col = flat >> 6, flat & 63
    gap = np.empty(len(flat), np.int32)
    gap[:1], gap[1:] = col[:1], col[1:] - col[:-1]
    new = np.flatnonzero(row[1:] != row[:-1]) + 1
    gap[new] = col[new]
    run = gap - 1
    key = ((run & 15) << 8) + (blocks.ravel()[flat].astype(np.int32) + 128)
    per_row = np.bincount(row, minlength=n)
    zrl = run >> 4
    long_runs = bool(zrl.any())
    if long_runs:
        per_row = per_row + np.bincount(row, weights=zrl, minlength=n).astype(np.int64)
    final = np.zeros(n, np.int32)
    final[row] = col  # the last write of a row is its last column
    eob = final < 63
    items = 1 + per_row + eob
    ends = np.cumsum(items)
    starts = ends - items
    total = int(ends[-1]) if n else 0
    code, length = np.full(total, _ZRL[0], np.int64), np.full(total, _ZRL[1], np.int32)
    code[starts], length[starts] = _DCV[blocks[:, 0].astype(np.int32) + 128], _DCL[blocks[:, 0].astype(np.int32) + 128]
    within = np.arange(1, len(flat) + 1) if not long_runs else np.cumsum(zrl + 1)
    at = within + np.repeat(starts - (np.cumsum(per_row) - per_row), np.bincount(row, minlength=n))
    code[at], length[at] = _ACV[key], _ACL[key]
    code[ends[eob] - 1], length[ends[eob] - 1] = _EOB
    bit_ends = np.cumsum(length, dtype=np.int64)
    bits = np.diff(np.concatenate(([0], bit_ends[ends - 1])))
    size = (bits + 7) >> 3
    byte_ends = np.cumsum(size)
    shift = (byte_ends - size) * 8 - (bit_ends[ends - 1] - bits)
    first = bit_ends - length + np.repeat(shift, items)
    word = first >> 5
    heads = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
    wide = code.view(np.uint64) << (64 - (first & 31) - length).astype(np.uint64)
    whole = np.bitwise_or.reduceat(wide, heads)  # an item starts in every word of 32 bits and ends in the next at most
    out_len = int(byte_ends[-1])
    words = np.zeros(int(word[-1]) + 2, np.uint32)
    words[word[heads]] = (whole >> np.uint64(32)).astype(np.uint32)
    words[word[heads] + 1] |= (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    packed = words.byteswap().view(np.uint8)[:out_len]
    packed[byte_ends - 1] |= ((1 << ((8 - bits % 8) % 8)) - 1).astype(np.uint8)
    width = 1 + (packed == 255)
    width[byte_ends - 1] += np.where(last, 0, 2)
    stop = np.cumsum(width)
    out = np.zeros(int(stop[-1]), np.uint8)
    out[stop - width] = packed
    cut = stop[byte_ends - 1]
    out[cut[~last] - 2] = 0xFF
    out[cut[~last] - 1] = 0xD0 + nth[~last] % 8
    return out, cut


def encode_jpegs(payloads: list[bytes], n_bytes: list[int]) -> list[bytes]:
    """One baseline JPEG per payload (whose length is a positive multiple of 64).

    Every block ends at a restart, so blocks are coded PIECE bytes of payload at a time, whatever a payload's length.
    """
    out: list[list[bytes]] = []
    todo: list[tuple[int, bytes, np.ndarray, bool]] = []
    held = 0

    def coded() -> None:
        blocks = np.frombuffer(b"".join(x[1] for x in todo), np.int8).reshape(-1, 64)
        ends = np.cumsum([len(x[1]) // 64 for x in todo])
        flag = np.zeros(len(blocks), bool)
        flag[ends[[x[3] for x in todo]] - 1] = True
        scan, cut = _scans(blocks, flag, np.concatenate([x[2] for x in todo]))
        cut = np.concatenate(([0], cut[ends - 1])).tolist()
        scan = scan.tobytes()
        for (i, *_), a, z in zip(todo, cut, cut[1:], strict=False):
            out[i].append(scan[a:z])
        todo.clear()

    for i, (p, n) in enumerate(zip(payloads, n_bytes, strict=True)):
        used = len(p) // 64
        wide = int(np.ceil(np.sqrt(used)))
        high = -(-used // wide)
        note = f"bytes={n};payload={len(p)}".encode()
        frame = b"\x08" + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + b"\1\1\x11\0"
        out.append([b"\xff\xd8" + _segment(0xFE, note) + _TABLES[0] + _segment(0xC0, frame) + _TABLES[1]])
        whole = wide * high * 64
        for a in range(0, whole, PIECE):
            z = min(a + PIECE, whole)
            todo.append((i, p[a:z] + bytes(z - max(a, min(z, len(p)))), np.arange(a // 64, z // 64), z == whole))
            held += z - a
            if held >= PIECE:
                coded()
                held = 0
    if todo:
        coded()
    return [b"".join([*x, b"\xff\xd9"]) for x in out]


def parse_markers(data: bytes) -> dict:
    """What the marker segments of a baseline file say; ``scan`` is the range of its entropy-coded bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out = {"note": b"", "interval": 0, "quant": {}, "huff": {}, "data": data}
    at = 2
    while True:
        while data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            comps = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "comps": comps}
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline files are read")
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                out["quant"][body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            out["interval"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out["note"] = body
        elif marker == 0xDA:
            out["tables"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if data[-2:] != b"\xff\xd9":
                raise ValueError("the end marker is missing")
            out["scan"] = (at, len(data) - 2)
            return out


def _decode_lut(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits that may come next: the symbol and its code's length (0: none)."""
    symbols, lengths = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for s, (code, n) in _codes(list(spec[:16]), list(spec[16:])).items():
        symbols[code << (16 - n) : (code + 1) << (16 - n)], lengths[code << (16 - n) : (code + 1) << (16 - n)] = s, n
    return symbols, lengths


def _next(window: np.ndarray, pos: np.ndarray, lut: tuple[np.ndarray, np.ndarray], dc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next symbol and value at each bit position, and the positions after them."""
    w, sub = window[pos >> 3], pos & 7
    peek = (w >> (24 - sub)) & 0xFFFF
    symbol, length = lut[0][peek], lut[1][peek]
    if not length.all():
        raise ValueError("a Huffman code is unknown")
    size = symbol if dc else symbol & 15
    used = length + size
    value = (w >> (40 - sub - used)) & ((1 << size) - 1)
    value -= np.where((value < (1 << size) >> 1), (1 << size) - 1, 0)
    return symbol, value, pos + used


def _lockstep(files: list[dict], luma_only: bool) -> list[np.ndarray]:
    """Coefficients of the first component's blocks of files that share their layout, one (blocks, 64) array a file."""
    one = files[0]
    tables = {i: (d, a) for i, d, a in one["tables"]}
    luts = {k: _decode_lut(v) for k, v in one["huff"].items()}
    many = len(one["comps"]) > 1
    units = [(c, c == 0) for c, (_, h, v, _) in enumerate(one["comps"]) for _ in range(h * v if many else 1)]
    raw = np.frombuffer(b"".join(f["data"][slice(*f["scan"])] for f in files), np.uint8)
    sizes = np.array([f["scan"][1] - f["scan"][0] for f in files])
    ff = np.flatnonzero(raw[:-1] == 255)
    nxt = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[nxt == 0] + 1] = False
    restart = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
    keep[restart], keep[restart + 1] = False, False
    clean = np.concatenate((raw[keep], np.full(5, 255, np.uint8))).astype(np.int64)
    where = np.concatenate(([0], np.cumsum(keep)))
    starts = np.sort(np.concatenate((np.cumsum(sizes) - sizes, restart + 2)))
    window = clean[:-4] << 32 | clean[1:-3] << 24 | clean[2:-2] << 16 | clean[3:-1] << 8 | clean[4:]
    pos = where[starts] * 8
    mcus = np.array([f["mcus"] for f in files])
    step = np.where(np.array([f["interval"] for f in files]) > 0, [f["interval"] for f in files], mcus)
    parts = -(-mcus // step)
    if parts.sum() != len(pos):
        raise ValueError("restart markers don't match the interval")
    owner = np.repeat(np.arange(len(files)), parts)
    nth = np.arange(len(pos)) - np.repeat(np.cumsum(parts) - parts, parts)
    todo = np.minimum(step[owner], mcus[owner] - nth * step[owner])
    lumas = sum(x for _, x in units)
    base = np.concatenate(([0], np.cumsum(mcus)))[:-1][owner] * lumas + nth * step[owner] * lumas
    coef = np.zeros((int(mcus.sum()) * lumas, 64), np.int16)
    pred = np.zeros((len(one["comps"]), len(pos)), np.int64)
    for m in range(int(todo.max())):
        live = np.flatnonzero(todo > m)
        luma = 0
        for c, is_luma in units:
            d, a = tables[one["comps"][c][0]]
            _, value, p = _next(window, pos[live], luts[d], True)
            pred[c, live] += value
            row = base[live] + m * lumas + luma if is_luma else live
            if is_luma:
                coef[row, 0] = pred[c, live]
                luma += 1
            at, k, end = np.arange(len(live)), np.ones(len(live), np.int64), p.copy()
            while at.size:
                symbol, value, p = _next(window, p, luts[16 | a], False)
                k += symbol >> 4
                if (k > 63).any() and (symbol[k > 63] != 0xF0).any():
                    raise ValueError("a block has too many coefficients")
                if is_luma and not luma_only:
                    hit = symbol & 15 > 0
                    if hit.all():
                        coef[row, k] = value
                    else:
                        coef[row[hit], k[hit]] = value[hit]
                k += 1
                over = (symbol == 0) | (k > 63)
                if over.any():
                    end[at[over]] = p[over]
                    on = ~over
                    at, k, p, row = at[on], k[on], p[on], row[on]
            pos[live] = end
    cut = np.concatenate(([0], np.cumsum(mcus * lumas)))
    return [coef[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _parts(h: dict) -> Iterator[dict]:
    """A file's scan in parts of about PIECE bytes, cut at restarts, which depend on nothing before them."""
    a, z = h["scan"]
    if not h["interval"] or z - a <= PIECE:
        yield h
        return
    raw = np.frombuffer(h["data"], np.uint8, z - a, a)
    ff = np.flatnonzero(raw[:-1] == 255)
    marks = ff[(raw[ff + 1] >= 0xD0) & (raw[ff + 1] <= 0xD7)]
    step, segments = h["interval"], -(-h["mcus"] // h["interval"])
    if len(marks) + 1 != segments:
        raise ValueError("restart markers don't match the interval")
    per = max(1, segments * PIECE // (z - a))
    for s in range(0, segments, per):
        begin, end = a + int(marks[s - 1]) + 2 if s else a, a + int(marks[s + per - 1]) if s + per < segments else z
        yield {**h, "scan": (begin, end), "mcus": min(per * step, h["mcus"] - s * step)}


def decode_jpegs(files: list[bytes], luma_only: bool = False) -> list[dict]:
    """For each file: width, height, note, coef (blocks, 64) of the luminance, and the DC-only thumbnail."""
    heads = [parse_markers(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        hs, vs = (max(c[1] for c in h["comps"]), max(c[2] for c in h["comps"])) if len(h["comps"]) > 1 else (1, 1)
        h["grid"] = (-(-h["height"] // (8 * vs)), -(-h["width"] // (8 * hs)))
        h["mcus"] = h["grid"][0] * h["grid"][1]
        groups.setdefault((tuple(h["comps"]), tuple(h["tables"]), *(x for kv in sorted(h["huff"].items()) for x in kv)), []).append(i)
    for members in groups.values():
        parts = [(i, p) for i in members for p in _parts(heads[i])]
        found: dict[int, list[np.ndarray]] = {}
        for a, z in _slices([p["scan"][1] - p["scan"][0] for _, p in parts], 2 * PIECE):
            for (i, _), coef in zip(parts[a:z], _lockstep([p for _, p in parts[a:z]], luma_only), strict=True):
                found.setdefault(i, []).append(coef)
        for i, coefs in found.items():
            heads[i]["coef"] = coefs[0] if len(coefs) == 1 else np.concatenate(coefs)
    for h in heads:
        _, fh, fv, q = h["comps"][0]
        fh, fv = (fh, fv) if len(h["comps"]) > 1 else (1, 1)
        grid = h["coef"][:, 0].reshape(*h["grid"], fv, fh).swapaxes(1, 2).reshape(h["grid"][0] * fv, h["grid"][1] * fh)
        h["thumb"] = np.clip(np.rint(grid * (h["quant"][q] / 8)) + 128, 0, 255).astype(np.uint8)
    return heads


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: which of 8 x 8 sampled pixels are brighter than their mean."""
    rows = np.arange(8) * thumb.shape[0] // 8
    cols = np.arange(8) * thumb.shape[1] // 8
    small = thumb[rows][:, cols].astype(np.float64)
    return np.packbits((small > small.mean()).ravel()).tobytes().hex()


def _slices(sizes: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes, one row at least."""
    a, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if sizes:
        yield a, len(sizes)


def write_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 bytes as a JPEG file.  No shuffle."""

    def run(batches):
        for b in byte_slices(batches, 1, SLICE):
            part = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(1).cast(pa.large_binary())]
            sizes = [len(x) for x in part]
            media = encode_jpegs([x + bytes(-len(x) % 64 or (0 if x else 64)) for x in part], sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def read_media(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id_col, n_bytes, payload, width, height, thumb_width, thumb_height, thumb_hash, media_bytes, media_sha256)."""

    def run(batches):
        names = ["id", "n_bytes", "payload", "width", "height", "thumb_width", "thumb_height", "thumb_hash", "media_bytes", "media_sha256"]
        kinds = [None, pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.string()]
        for b in byte_slices(batches, 1, SLICE):
            part = b.column(1).to_pylist()
            found = iter(decode_jpegs([x for x in part if x is not None]))
            rows = []
            for x in part:
                if x is None:
                    rows.append([None] * 9)
                    continue
                h = next(found)
                note = dict(kv.split(b"=") for kv in h["note"].split(b";") if b"=" in kv)
                payload = h["coef"].astype(np.int8).tobytes()[: int(note.get(b"payload", h["coef"].size))]
                rows.append([int(note.get(b"bytes", len(payload))), payload, h["width"], h["height"], h["thumb"].shape[1], h["thumb"].shape[0], thumbnail_hash(h["thumb"]), len(x), hashlib.sha256(x).hexdigest()])
                h.clear()
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[i] for r in rows], kinds[i + 1]) for i in range(9)], names)

    kind = df.select(id_col).schema[0].dataType.simpleString()
    out = f"id {kind}, n_bytes bigint, payload binary, width bigint, height bigint, thumb_width bigint, thumb_height bigint, thumb_hash string, media_bytes bigint, media_sha256 string"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document: stored as media, read back, digested."""
    back = read_media(write_media(docs, "doc_id", "text"), "doc_id")
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), F.concat_ws("x", "thumb_width", "thumb_height"), "thumb_hash").alias("feature"),
    )
