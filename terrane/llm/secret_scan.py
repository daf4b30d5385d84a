"""Secrets in texts: fixed patterns, and strings in sensitive places that zstandard can't compress.

Words of the whole corpus are counted by Spark; the most frequent become the identifier dictionary, of at most
``DICTIONARY`` bytes, that zstandard is primed with.  High-recall generators propose strings: what stands behind a
sensitive name, the password of an address, tokens with a known beginning, the body of a private key.  A candidate's
novelty is its marginal compressed size: the bytes that it adds where the dictionary and the text around it are known.
Names, words, paths and parts of what stands nearby add little, random strings nearly all their bytes.  Strings of
``NOVELTY`` bytes a character (``NOVEL_BEYOND`` beyond ``SHORT``) and ``LEAST`` bytes in all are reported as ``novel``.

Compression looks at lower case, ``AROUND`` characters to either side.  Words of the dictionary have 4 to 15 letters, so
that a secret that occurs often doesn't become a word.  The driver holds the dictionary, nothing else of the corpus.

Defined results: a null text is an empty text and has no spans; whole texts are read, whatever their length; spans count
code points, the end excluded; spans of fixed patterns stay, a candidate that meets one of them, or an earlier candidate,
is left out; words of equal count are taken in alphabetic order; repeated rows give repeated results, an empty table no
rows; other columns are left out by ``find_secrets`` and kept, whatever their names, by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import byte_slices, fresh, release, stored

DICTIONARY, AROUND, LEVEL, NOVELTY, NOVEL_BEYOND, LEAST, SHORT = 1 << 16, 160, 13, 0.78, 0.6, 8, 256
#: Different words that a task counts before it hands them on.
COUNTED = 1 << 18
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX, WORD = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{32,}"), re.compile("[A-Z]?[a-z]{3,}")
#: Names that what follows may be a secret of, what may stand between, and what secrets are made of.
NAMES = r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|license|encryption|signing|account|shared|master|client|ssh|ssl)[ _-]?key|auth(?:orization)?|bearer|credentials?|signature|session(?:[ _-]?id)?|cookie|conn(?:ection)?[ _-]?str(?:ing)?|(?<![A-Za-z])(?:pass|key|pin|otp|salt|nonce))"
GAP = r"""[A-Za-z0-9_-]{0,24}["'`\])]{0,2}[ \t]{0,4}(?:(?::=|=>|->|[:=,]|is\b|was\b)[ \t]{0,4})?["'`(<]{0,2}(?:(?:bearer|basic|token)[ ])?"""
NAMED = re.compile(rf"{NAMES}{GAP}(?<![A-Za-z0-9])([A-Za-z0-9+/_=.~!@#$%^&*-]{{8,}})", re.I | re.A)
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s@/]{6,})@", re.I | re.A)
BEGUN = re.compile(r"(?<![A-Za-z0-9])((?:gh[pousr]_|github_pat_|glpat-|sk[_-](?:live|test|proj)?[_-]?|rk_live_|xox[abeprs]-|AIza|ya29\.|SG\.|npm_|pypi-|hf_|eyJ|ASIA)[A-Za-z0-9_.=-]{16,})", re.A)
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]{16,})")
#: What a text must hold, in RE2, for its patterns to be tried.
BASE_HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
NOVEL_HINT = r"(?i:pass|pwd|secret|token|key|auth|bearer|credential|signature|session|cookie|conn|pin|otp|salt|nonce|://[^\s:/@]{1,64}:)|gh[pousr]_|github_pat_|glpat-|sk[_-]|rk_live_|xox[abeprs]-|AIza|ya29\.|SG\.|npm_|pypi-|hf_|eyJ|ASIA"


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all texts: pieces of identifiers and words, in lower case."""

    def handed(counts):
        words = [(w.lower(), n) for w, n in counts.items() if 4 <= len(w) <= 15]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for b in byte_slices(batches):
            counts.update(WORD.findall("\n".join(b.column(0).fill_null("").to_pylist())))
            if len(counts) > COUNTED:
                yield handed(counts)
                counts = Counter()
        yield handed(counts)

    return df.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def identifier_dictionary(df: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> bytes:
    """The corpus's most frequent words, the rarest first, as zstandard finds what is last most cheaply."""
    many, bucket = most // 5, F.floor(F.log2("n") * 8).cast("int").alias("bucket")
    counts = stored(word_counts(df, text_col).where("n > 1").select("word", "n", bucket))
    bound, seen = 0, 0
    for r in counts.groupBy("bucket").count().orderBy(F.desc("bucket")).collect():  # at most 504 of them
        bound, seen = r["bucket"], seen + r["count"]
        if seen >= many:
            break
    words = [r["word"] for r in counts.where(F.col("bucket") >= bound).orderBy(F.desc("n"), "word").limit(many).collect()]
    release(counts)
    out, size = [], 0
    for w in words:
        size += len(w) + 1
        if size > most:
            break
        out.append(w)
    return " ".join(reversed(out)).encode()


class Novelty:
    """Marginal compressed bytes of strings inside their surroundings, under a dictionary of words.

    Noise and a repetition of it go before every text: with them zstandard neither codes letters by their frequency nor
    gives up compressing, in a short text, so that what it can't find costs a byte a character.
    """

    noise = hashlib.shake_256(b"noise").digest(512)

    def __init__(self, dictionary: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(dictionary) >= 8:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
            options["dict_data"] = primed
        self.compress = zstandard.ZstdCompressor(**options).compress

    def size(self, text: str) -> int:
        return len(self.compress(self.noise + self.noise[:128] + text.lower().encode()))

    def __call__(self, text: str, start: int, end: int) -> int:
        own = text[start:end]
        before, after = (t.replace(own, " ") for t in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))  # a secret may be said twice
        return self.size(before + own + after) - self.size(before + after)


def enough(size: int) -> float:
    """Bytes from which a string of this many characters is novel: zstandard codes the letters of strings beyond SHORT
    characters by their frequency, random ones too."""
    return max(LEAST, NOVELTY * min(size, SHORT) + NOVEL_BEYOND * max(0, size - SHORT))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of strings in sensitive contexts, overlapping ones included, the surest first."""
    found = [m.span(1) for p in (BLOCK, ADDRESS, BEGUN) for m in p.finditer(text)]
    at = 0
    while m := NAMED.search(text, at):  # again from the string on: it may name the next one
        a, z = m.span(1)
        while z > a and text[z - 1] in ".!,":
            z -= 1
        if z - a >= 8 and likely(text[a:z]):
            found.append((a, z))
        at = max(a, m.start() + 1)
    return found


def likely(s: str) -> bool:
    """Not a word, nor words and short numbers joined by signs: a part mixes letters and digits other than by a number
    at its end, or cases within a word, or is too long for a word, or signs that paths and names lack are inside."""
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", s) if p]
    odd = lambda p: bool(re.search("[0-9][A-Za-z]", p) or re.search("[A-Za-z][0-9]{5}", p) or re.search("[a-z][A-Z]", p) or len(p) >= (20 if p.isdigit() else 32))
    return any(map(odd, parts)) or bool(re.search(r"[!@#$%^&*~]", s[1:-1]))


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, marginal bytes) of incompressible candidates that meet no other span."""
    taken, out = [(a, z) for a, _, z in base], []
    for a, z in candidates(text):
        if any(a < e and s < z for s, e in taken):
            continue
        more = novelty(text, a, z)
        if more >= enough(z - a):
            taken.append((a, z))
            out.append((a, 3, z, more))
    return out


def find_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", dictionary: bytes | None = None) -> DataFrame:
    """(<id>, spans array<struct<kind, start, end, marginal, value>>) by start, then kind; ``marginal`` is null for fixed
    patterns.  The dictionary comes from ``df`` unless it is given."""
    words = identifier_dictionary(df, text_col) if dictionary is None else dictionary
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.int32()), ("value", pa.string())])

    def run(batches):
        novelty = Novelty(words)
        for b in byte_slices(batches):
            texts = b.column(0).fill_null("")
            base, more = (pc.match_substring_regex(texts, h).to_pylist() for h in (BASE_HINT, NOVEL_HINT))
            out = []
            for i, (p, q) in enumerate(zip(base, more, strict=True)):
                found: list = []
                if p or q:
                    t = texts[i].as_py()
                    fixed = base_spans(t) if p else []
                    found = [(*s, None) for s in fixed] + (novel_spans(t, fixed, novelty) if q else [])
                out.append([{"kind": KINDS[k], "start": a, "end": z, "marginal": n, "value": t[a:z]} for a, k, z, n in sorted(found, key=lambda s: s[:3])])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(span))], ["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(text_col).alias("t"), F.col(id_col).alias("id")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int,marginal:int,value:string>>")
    return rows.withColumnRenamed("id", id_col)


def redact_secrets(df: DataFrame, text_col: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """``df`` with ``<SECRET>`` in place of every span; a null text stays null."""
    words = identifier_dictionary(df, text_col) if dictionary is None else dictionary
    new = fresh(df, "redacted")

    def run(batches):
        novelty = Novelty(words)
        for b in byte_slices(batches, at):
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    fixed, end, parts = base_spans(t), 0, []
                    for a, z in sorted([(s[0], s[2]) for s in fixed] + [(s[0], s[2]) for s in novel_spans(t, fixed, novelty)]):
                        if z > end:
                            parts += [t[end:a], "<SECRET>"] if a >= end else []
                            end = z
                    t = "".join(parts) + t[end:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, new])

    names = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text_col)
    types = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema, strict=True))
    rows = df.toDF(*names).mapInArrow(run, f"{types}, {new} string")
    return rows.select(*[F.col(new if i == at else n).alias(c) for i, (n, c) in enumerate(zip(names, df.columns, strict=True))])


def secrets_digest(df: DataFrame) -> DataFrame:
    """Per document the number of spans of each fixed kind, a digest of them, and all spans as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    many = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return find_secrets(df).select("doc_id", *[many(k).alias(f"n_{k}") for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
