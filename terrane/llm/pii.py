"""Personal data and secrets: high-recall span generators, boosted trees over format and context, calibrated redaction.

Everything on the main path is a DataFrame expression.  A generator is a pattern; its matches are found by marking
them in the text, splitting at the marks and adding up the lengths of the pieces, which costs one pass of the pattern.
Base spans (a pattern's match that passes its check) always stay.  Further generators run over the text in which base
spans are blanked out, so that an added span never overlaps one.  What they propose is scored by boosted trees of depth
two over yes/no features of format and context, and accepted from a threshold on.

Nobody labels spans, so the trees learn from two sources, both of proposals that the generators make.  Examples are made
by rule, true and false ones of each kind, among them near misses such as numbers that fail Luhn's check, book numbers,
hardware addresses, names and paths; their truth is known, so all features may be used.  Proposals of the corpus are
labelled by the words before them, where these name the kind or speak of something else; their context features are
masked, so that no tree reads its label, and they teach what the formats look like there.  Spark counts the proposals
of every combination of features, at most 5 kinds times 2^16 rows, whatever the input, and the boosting runs on that
table.  Documents whose crc32(id) modulo 5 is 0, and examples made from other seeds, are kept for the calibration, which
takes each kind's lowest threshold with precision 0.95.  Every tree chooses among its own part of the features.

Defined results: null texts count as empty and have no spans (``redact`` leaves them null); rows are treated one by one,
so repeated rows give repeated results; an empty table gives no rows; other columns pass through ``redact`` unchanged, as
do all characters outside spans.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import fresh

# The kinds, in order, and the base patterns, written so that no text makes them backtrack: a quantifier
# is possessive where nothing after it could use what it gives back, and a run is entered at its start or where the
# match before ended.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: All kinds of spans.
ALL = (*KINDS, "secret")
#: Generators beyond the base patterns: (kind, pattern).
MORE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+"),
    # groups of four first, so that of two numbers side by side both are proposed
    ("card", r"(?<![0-9A-Za-z.=+-])(?:[0-9]{4}[\x20.-]?){3}[0-9]{4}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z.=+-])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.=+-])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
)
#: Texts without a match of this hold nothing that any generator proposes.
ANY = r"[0-9@]|[\[(] ?at ?[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]"
#: What assigns a secret, at the end of the text before it; words near a kind.
ASSIGNED = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|credential|bearer)[\"']?\s*[:=]?\s*[\"']?$"
NAMED = {"email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|addr|server", "card": r"(?i)card|visa|pay|credit", "phone": r"(?i)phone|tel|call|mobile|fax|ring", "secret": r"(?i)auth|api|login"}
OTHER = r"(?i)version|isbn|order|\bid\b|serial|page|\bmac\b|ethernet|sha|commit|path|invoice|ref|ratio|time|class|import|http|file|article|number of"
NEAR = 32
FEATURES = ("digits_7_9", "digits_10_12", "digits_13_16", "digits_17_24", "luhn", "address", "other_format", "grouped", "opened", "letters", "mixed", "named", "other", "joined", "quoted", "domain")
#: The bits of context, which are masked where context gives the label.
CONTEXT = sum(1 << FEATURES.index(f) for f in ("named", "other", "quoted"))
#: Trees of a kind, features that each may use, learning rate, and the precision that thresholds are set for.
ROUNDS, PART, RATE, PRECISION = 24, 8, 0.5, 0.95


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits passes Luhn's check; False for other lengths."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("double") <= 255, F.lit(False)))


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(m)
    if kind == "card":
        return luhn(digits_of(m))
    if kind == "secret":
        return F.lit(False)
    return F.length(digits_of(m)).between(9, 15)


def pieces(text: Column, pattern: str) -> Column:
    r"""The text cut at a pattern's matches: gap, match, gap, ..., gap.  The text has no U+0001."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x01")), "\x01", -1)


def with_matches(df: DataFrame, found: list[tuple[str, str, Column, str]], check=None, chunk: int = 256) -> DataFrame:
    """``df`` with an array<struct<m, at, bits, good>> per (column, kind, text, pattern): a pattern's matches.

    ``at`` is where a match starts, in characters, ``bits`` its features, ``good`` what ``check`` (kind, match) says of it,
    which by default is the check of its kind.  Every step is a column of its own, so that Spark works it out once a row.  The running sum of the pieces'
    lengths has two levels, chunks of pieces and pieces in a chunk, so that it stays cheap for very many matches.
    """
    rest, names = df.columns, [x[0] for x in found]
    empty = F.array().cast("array<int>")

    def sums(sizes, first):
        return F.aggregate(sizes, F.struct(first.alias("at"), empty.alias("out")), lambda a, n: F.struct((a.at + n).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")), lambda a: a.out)

    def match(kind, parts):
        def made(row, i):
            near = F.struct(row.p.alias("m"), row.s.alias("at"), F.right(F.get(parts, i - 1), F.lit(NEAR)).alias("pre"), F.coalesce(F.left(F.get(parts, i + 1), F.lit(1)), F.lit("")).alias("post"))
            return F.when(i % 2 == 1, F.struct(row.p.alias("m"), row.s.alias("at"), feature_bits(kind, near).alias("bits"), (check(kind, near) if check else valid(kind, row.p)).alias("good")))

        return made

    df = df.select(*rest, *[pieces(text, pattern).alias(f"{c}_p") for c, _, text, pattern in found])
    df = df.select("*", *[F.transform(f"{c}_p", F.length).alias(f"{c}_n") for c in names])
    df = df.select("*", *[F.transform(F.sequence(F.lit(0), ((F.size(f"{c}_n") - 1) / chunk).cast("int")), _slice(F.col(f"{c}_n"), chunk)).alias(f"{c}_c") for c in names])
    df = df.select("*", *[sums(F.transform(f"{c}_c", lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)), F.lit(0)).alias(f"{c}_f") for c in names])
    df = df.select("*", *[F.flatten(F.zip_with(f"{c}_c", f"{c}_f", sums)).alias(f"{c}_s") for c in names])
    df = df.select("*", *[F.zip_with(f"{c}_p", f"{c}_s", lambda p, s: F.struct(p.alias("p"), s.alias("s"))).alias(f"{c}_r") for c in names])
    return df.select(*rest, *[F.when(F.size(f"{c}_p") > 1, F.filter(F.transform(f"{c}_r", match(kind, F.col(f"{c}_p"))), lambda x: x.isNotNull())).otherwise(F.array().cast(MATCHES)).alias(c) for c, kind, _, _ in found])


MATCHES = "array<struct<m:string,at:int,bits:int,good:boolean>>"


def _slice(sizes: Column, chunk: int):
    return lambda c: F.slice(sizes, c * chunk + 1, F.lit(chunk))


def feature_bits(kind: str, r: Column) -> Column:
    """The yes/no features of a match as the bits of an integer, in the order of FEATURES."""
    m, n = r.m, F.length(digits_of(r.m))
    flags = (
        n.between(7, 9),
        n.between(10, 12),
        n.between(13, 16),
        n.between(17, 24),
        luhn(digits_of(m)) if kind == "card" else F.lit(False),
        m.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$") if kind == "ip" else F.lit(False),
        m.rlike(r"^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$|^97[89][-\x20]?[0-9]|^(.)\1*$|^0{3}|^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$"),
        m.rlike(r"[0-9][\x20.-][0-9]"),
        m.rlike(r"^AKIA|^ASIA|^gh[pousr]_|^sk_|^xox[a-z]-" if kind == "secret" else r"^[+(]"),
        m.rlike("[A-Za-z]"),
        m.rlike(r"[0-9][A-Za-z]") & m.rlike(r"[A-Za-z][0-9]"),
        r.pre.rlike(ASSIGNED if kind == "secret" else NAMED[kind]),
        r.pre.rlike(OTHER),
        r.pre.rlike(r"[0-9A-Za-z_/-]$") | r.post.rlike(r"^[0-9A-Za-z_/]"),
        r.pre.rlike("[\"']$") & r.post.rlike("^[\"']"),
        m.rlike(r"(?:@|\bat\b).*(?:\.|\bdot\b[\])]?\x20?)(?i:com|org|net|edu|gov|info|io|example|test|[a-z]{2})$"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def label(kind: str, r: Column) -> Column:
    """Whether a proposal is of its kind by the words before it alone; NULL where they don't say."""
    named, other = r.pre.rlike(ASSIGNED if kind == "secret" else NAMED[kind]), r.pre.rlike(OTHER)
    return F.when(named & ~other, True).when(other & ~named, False)


def with_check(digits: str) -> str:
    """The digits with a last one that satisfies Luhn's check."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return digits + str(-total % 10)


def examples(seed: int, many: int = 24) -> list[tuple[str, str, bool]]:
    """(text, kind, truth): ``many`` true and false proposals of each kind beyond the base patterns, made by rule."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    word = lambda: some(low, rng.randint(3, 9))
    groups = lambda d, by: by.join(d[i : i + 4] for i in range(0, len(d), 4))
    out = []
    for _ in range(many):
        at, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)")])
        end = rng.choice(["com", "org", "net", "de", "example"])
        named = rng.choice(["", "", "mail ", "contact "])
        out.append((f"{named}{word()}.{word()} {at} {word()} {dot} {end}", "email", True))
        out.append((f"{rng.choice(['', 'meet '])}{word()} {at} {word()} {dot} {some(low, rng.randint(5, 9))}", "email", False))
        full = [some(hexa, 4) for _ in range(8)]
        out.append((f"{rng.choice(['', 'host ', 'server '])}{rng.choice([':'.join(full), f'{full[0]}::{full[1]}:{full[2]}', f'fe80::{full[3]}:{full[4]}:{full[5]}'])}", "ip", True))
        pairs = [some(hexa, 2) for _ in range(6)]
        out.append((f"{rng.choice(['', 'mac ', 'host '])}{rng.choice([':'.join(pairs), f'{some(digit, 2)}:{some(digit, 2)}:{some(digit, 2)}', ':'.join(pairs[:4])])}", "ip", False))
        own = with_check(rng.choice("3456") + some(digit, 14))
        out.append((f"{rng.choice(['', '', 'card ', 'visa '])}{rng.choice([own, groups(own, ' '), groups(own, '.'), groups(own, '-')])}", "card", True))
        wrong = own[:-1] + str((int(own[-1]) + rng.randint(1, 9)) % 10)
        book = "978" + some(digit, 10)
        out.append((f"{rng.choice(['', '', 'card ', 'order '])}{rng.choice([wrong, groups(wrong, ' '), wrong])}", "card", False))
        out.append((f"{rng.choice(['', 'isbn '])}{rng.choice([book, f'978-{some(digit, 1)}-{some(digit, 2)}-{some(digit, 6)}-{some(digit, 1)}'])}", "card", False))
        a, b, c = some("23456789", 1) + some(digit, 2), some(digit, 3), some(digit, 4)
        out.append((f"{rng.choice(['', 'call ', 'phone ', 'tel '])}{rng.choice([f'({a}) {b}-{c}', f'{a}-{b}-{c}', f'1-{a}-{b}-{c}'])}", "phone", True))
        out.append((f"{rng.choice(['order ', 'id ', 'serial ', 'ref '])}{rng.choice([f'{a}-{b}-{c}', f'{a}.{b}.{c}', f'{a} {b} {c}'])}", "phone", False))
        mixed = rng.choice([some(low + low.upper() + digit, rng.randint(20, 40)), some(hexa, rng.randint(16, 40))])
        key, quote = rng.choice(["token = ", "api_key: ", "secret=", "password: "]), rng.choice(["", '"', "'"])
        out.append((f"{key}{quote}{mixed}{quote}", "secret", True))
        out.append((f"{rng.choice(['', 'key ', 'at '])}AKIA{some(low.upper() + digit, 16)}", "secret", True))
        joined = rng.choice(["_", "-", "/"]).join(word() for _ in range(5))
        out.append((f"{rng.choice(['', 'path ', 'file ', 'token = '])}{quote}{rng.choice([joined, joined.replace('_', ''), '=' * 24])}{quote}", "secret", False))
        out.append((f"{rng.choice(['commit ', 'sha ', ''])}{some(hexa, 40)}", "secret", False))
    return [(f"{word()} {t} {word()}", k, truth) for t, k, truth in out]


@dataclass
class Trees:
    """Per kind a start value and trees (feature, left, right), a side being (feature, no, yes); and the thresholds."""

    start: dict[str, float]
    trees: dict[str, list]
    threshold: dict[str, float]

    def score(self, kind: str, bits: int) -> float:
        total = self.start[kind]
        for f, no, yes in self.trees[kind]:
            g, a, b = yes if bits >> f & 1 else no
            total += b if bits >> g & 1 else a
        return 1 / (1 + math.exp(-total))

    def accepts(self, kind: str, bits: Column) -> Column:
        """The trees as one expression."""
        has = lambda f: bits.bitwiseAND(1 << f) > 0
        side = lambda s: F.when(has(s[0]), F.lit(s[2])).otherwise(F.lit(s[1]))
        total = F.lit(self.start[kind])
        for f, no, yes in self.trees[kind]:
            total = total + F.when(has(f), side(yes)).otherwise(side(no))
        t = self.threshold[kind]
        return total >= math.log(t / (1 - t)) if t < 1 else F.lit(False)


def boost(rows: list[tuple[int, float, float]]) -> tuple[float, list]:
    """Gradient boosting of trees of depth two on (bits, positives, negatives)."""
    p, n = sum(r[1] for r in rows), sum(r[2] for r in rows)
    start = math.log((p + 1) / (n + 1))
    score, trees = [start] * len(rows), []
    every = range(len(rows))

    def leaf(own, g, h):
        return -RATE * sum(g[i] for i in own) / (sum(h[i] for i in own) + 1.0)

    def gain(own, g, h):
        return sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + 1.0)

    def best(own, g, h, among):
        def worth(f):
            yes = [i for i in own if rows[i][0] >> f & 1]
            no = [i for i in own if not rows[i][0] >> f & 1]
            return gain(yes, g, h) + gain(no, g, h)

        f = max(among, key=worth)
        return f, [i for i in own if not rows[i][0] >> f & 1], [i for i in own if rows[i][0] >> f & 1]

    rng = random.Random(7)
    for _ in range(ROUNDS if rows else 0):
        among = sorted(rng.sample(range(len(FEATURES)), PART))
        prob = [1 / (1 + math.exp(-s)) for s in score]
        g = [(rows[i][1] + rows[i][2]) * prob[i] - rows[i][1] for i in every]
        h = [(rows[i][1] + rows[i][2]) * prob[i] * (1 - prob[i]) for i in every]
        f, no, yes = best(every, g, h, among)
        sides = []
        for own in (no, yes):
            k, a, b = best(own, g, h, among)
            sides.append((k, leaf(a, g, h), leaf(b, g, h)))
            for part, v in ((a, sides[-1][1]), (b, sides[-1][2])):
                for i in part:
                    score[i] += v
        trees.append((f, *sides))
    return start, trees


def _prepared(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with the text to search: null is empty, and so are texts that no generator touches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.when(text.rlike(ANY), F.translate(text, "\x01", "\x02")).otherwise(""))


def _example_rows(spark) -> DataFrame:
    """(t, kept, made, truth) of all examples.  They are one literal: a plan with four of each would fill the driver."""
    made = [{"t": t, "kept": part, "made": k, "truth": truth} for part, seed in ((False, 1), (True, 2)) for t, k, truth in examples(seed)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made)), "array<struct<t:string,kept:boolean,made:string,truth:boolean>>")))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Trees:
    """Count the proposals by kind, features and label, then boost and calibrate."""
    spark = docs.sparkSession
    kept = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
    none = F.lit(None)
    rows = docs.select(F.col(text_col).alias("t"), kept.alias("kept"), none.cast("string").alias("made"), none.cast("boolean").alias("truth"))
    fixed = _example_rows(spark)
    base = _prepared(rows.unionByName(fixed), "t", "clean").where("clean <> ''").select("kept", "made", "truth", "clean")
    found = with_matches(base, [(f"m_{j}", k, F.col("clean"), p) for j, (k, p) in enumerate(MORE)], label)

    def example(k):
        own = F.col("made") == k
        return lambda r: F.struct(F.lit(k).alias("kind"), F.when(own, r.bits).otherwise(r.bits.bitwiseAND(((1 << len(FEATURES)) - 1) ^ CONTEXT)).alias("bits"), F.when(own, F.col("truth")).when(F.col("made").isNull(), r.good).alias("good"))

    each = F.concat(*[F.transform(f"m_{j}", example(k)) for j, (k, _) in enumerate(MORE)])
    counted = found.select("kept", F.inline(each)).where("good is not null").groupBy("kept", "kind", "bits").agg(F.count_if("good").alias("p"), F.count_if(~F.col("good")).alias("n"))
    # at most two times five times 2^16 rows
    table = counted.collect()
    start, trees, threshold = {}, {}, {}
    for k in ALL:
        learn = sorted((r["bits"], r["p"], r["n"]) for r in table if r["kind"] == k and not r["kept"])
        start[k], trees[k] = boost(learn)
    out = Trees(start, trees, threshold)
    for k in ALL:
        held = sorted(((out.score(k, r["bits"]), r["p"], r["n"]) for r in table if r["kind"] == k and r["kept"]), reverse=True)
        p = n = 0
        threshold[k] = 1.0
        for (s, a, b), (below, _, _) in zip(held, [*held[1:], (0.0, 0, 0)], strict=True):
            p, n = p + a, n + b
            if p and p / (p + n) >= PRECISION:  # halfway to the next lower score
                threshold[k] = min(max((s + below) / 2, 0.5), 1 - 1e-9)
    return out


def _bounds(found: Column) -> Column:
    return F.transform(found, lambda r: F.struct(r.at.alias("begin"), (r.at + F.length(r.m)).alias("end")))


def find_spans(docs: DataFrame, trees: Trees, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and per kind K the arrays base_K (not for secrets) and more_K of struct<begin, end>.  No shuffle."""
    df = _prepared(docs.select(F.col(text_col).alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]), "_t", "_clean").drop("_t")
    ids = [f"_k{i}" for i in range(len(keep))]
    df = with_matches(df, [(f"_m_{k}", k, F.col("_clean"), BASE[k]) for k in KINDS])
    df = df.select(*ids, "_clean", *[_bounds(F.filter(f"_m_{k}", lambda r: r.good)).alias(f"base_{k}") for k in KINDS])
    df = df.select("*", F.flatten(F.array(*[f"base_{k}" for k in KINDS])).alias("_all"))
    df = df.withColumn("_masked", _blanked(F.col("_clean"), F.col("_all"))).drop("_clean", "_all")
    for j, (kind, pattern) in enumerate(MORE):
        df = with_matches(df, [("_m", kind, F.col("_masked"), pattern)])
        df = df.withColumn(f"_more{j}", _bounds(F.filter("_m", _accepted(trees, kind)))).drop("_m")
        df = df.withColumn("_masked", _blanked(F.col("_masked"), F.col(f"_more{j}")))
    more = {k: F.array_sort(F.concat(F.array().cast("array<struct<begin:int,end:int>>"), *[F.col(f"_more{j}") for j, (kind, _) in enumerate(MORE) if kind == k])) for k in ALL}
    return df.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"base_{k}") for k in KINDS], *[more[k].alias(f"more_{k}") for k in ALL])


def _accepted(trees: Trees, kind: str):
    return lambda r: trees.accepts(kind, r.bits)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with the characters of the spans replaced by U+0002, of the same length.

    Characters from the end of one span to the begin of the next are copied as one piece; an overlap is skipped.
    """
    step = F.array_sort(spans)
    folded = F.aggregate(
        step,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(F.greatest(a.at, s.end).alias("at"), F.when(s.end <= a.at, a.out).otherwise(F.concat(a.out, F.array(F.substring(text, a.at + 1, F.greatest(s.begin - a.at, F.lit(0))), F.repeat(F.lit("\x02"), s.end - F.greatest(a.at, s.begin))))).alias("out")),
        lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.at + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(folded)


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document, then n_spans (all spans) and n_secret."""
    found = find_spans(docs, train(docs))

    def texts(spans, k):
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(k), s.begin, s.end))

    base = F.concat(*[texts(F.col(f"base_{k}"), k) for k in KINDS])
    every = F.concat(*[texts(F.array_sort(F.concat(f"base_{k}", f"more_{k}") if k in KINDS else F.col(f"more_{k}")), k) for k in ALL])
    return found.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), F.size(every).cast("long").alias("n_spans"), F.size("more_secret").cast("long").alias("n_secret"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every base span and every accepted span of the text replaced by its kind in angle brackets.

    The generators run one after the other over the text as redacted so far, since a tag matches none of them.
    A null text stays null.  U+0001 and U+0002 are spelled as two control characters while U+0001 marks matches.
    """
    trees = train(docs, text_col, id_col)
    work, parts, bits = fresh(docs, "pii_text"), fresh(docs, "pii_parts"), fresh(docs, "pii_bits")
    spelled = F.replace(F.replace(F.col(text_col), F.lit("\x02"), F.lit("\x02\x04")), F.lit("\x01"), F.lit("\x02\x03"))
    plain = F.replace(F.replace(F.col(work), F.lit("\x02\x03"), F.lit("\x01")), F.lit("\x02\x04"), F.lit("\x02"))

    def features(kind):
        def of(p, i):
            near = F.struct(p.alias("m"), F.right(F.get(F.col(parts), i - 1), F.lit(NEAR)).alias("pre"), F.coalesce(F.left(F.get(F.col(parts), i + 1), F.lit(1)), F.lit("")).alias("post"))
            return F.when(i % 2 == 1, feature_bits(kind, near))

        return of

    def checked(kind):
        return lambda p, i: F.when(i % 2 == 1, F.when(valid(kind, p), 1).otherwise(0))

    def replaced(kind, base):
        take = (lambda b: b == 1) if base else (lambda b: trees.accepts(kind, b))
        return lambda p, b: F.when(b.isNotNull() & take(b), F.lit(f"<{kind.upper()}>")).otherwise(p)

    df = docs.withColumn(work, F.when(F.col(text_col).rlike(ANY), spelled))
    for kind, pattern, base in [*((k, BASE[k], True) for k in KINDS), *((k, p, False) for k, p in MORE)]:
        df = df.withColumn(parts, pieces(F.col(work), pattern))
        df = df.withColumn(bits, F.when(F.size(parts) > 1, F.transform(F.col(parts), checked(kind) if base else features(kind))))
        df = df.withColumn(work, F.when(F.size(parts) > 1, F.array_join(F.zip_with(parts, bits, replaced(kind, base)), "")).otherwise(F.col(work)))
    return df.withColumn(text_col, F.coalesce(plain, text_col)).select(*docs.columns)
