"""Chat formatting: a compiler from a sandboxed template language to Python closures.

The language has ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in expression %}
{% endfor %}``, ``{% set x = expression %}`` and ``{% generation %} {% endgeneration %}``, whose text is what a loss
applies to.  Expressions have strings, integers, true, false, none, names, ``.key``, ``[key]``, ``+``, comparisons,
``in``, ``and``, ``or``, ``not`` and ``| filter``.  Keys are looked up in mappings and lists only, never as Python
attributes, and nothing can be called but the named filters, so that a template reaches nothing but its input.

``compile_template`` parses the source into a syntax tree, folds constants (an expression of constants becomes one
constant, an ``if`` on a constant its branch, neighbouring texts one text) and generates a closure per node.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mark turns in DEFAULT_TEMPLATE; inside texts they are escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]")

DEFAULT_TEMPLATE = """{% for m in messages %}{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]\
{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>\
{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>\
{% else %}[ROLE]{{ m.role | escape }}[/ROLE][TEXT]{{ m.text | escape }}[/TEXT]{% endif %}{% endfor %}"""


class TemplateError(ValueError):
    """The template can't be parsed, or asks for what the sandbox doesn't have."""


_CONTROL_RE = re.compile("|".join(sorted(map(re.escape, CONTROLS), key=len, reverse=True)))


def escape(text: str) -> str:
    r"""Doubles backslashes and puts ``\.`` after the first character of every control string."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    if "<" in text or "[" in text:
        while (cut := _CONTROL_RE.sub(lambda m: m[0][0] + "\\." + m[0][1:], text)) != text:
            text = cut
    return text


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return re.sub(r"\\(\\|\.)", lambda m: "\\" if m[1] == "\\" else "", text) if "\\" in text else text


FILTERS: dict[str, Callable] = {"escape": lambda v: escape(str(v)), "trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "length": lambda v: len(v)}

# Syntax trees are tuples: ("const", value), ("name", n), ("get", tree, tree), ("bin", op, tree, tree), ("not", tree),
# ("filter", n, tree), and for statements ("text", s), ("out", tree), ("if", [(tree, body)], body), ("for", n, tree, body),
# ("set", n, tree), ("gen", body).
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+<>|.\[\]()]))")
_CONSTANTS = {"true": True, "false": False, "none": None}
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b if not isinstance(a, str) and not isinstance(b, str) else f"{'' if a is None else a}{'' if b is None else b}", "-": lambda a, b: a - b,
}


def _look_up(value, key):
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected text: {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *texts: str) -> bool:
        kind, text = self.peek()
        if kind != "str" and text in texts and kind != "end":
            self.at += 1
            return True
        return False

    def want(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing before {self.peek()[1]!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "name":
            raise TemplateError(f"a name is missing before {text!r}")
        self.at += 1
        return text

    def whole(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("bin", "or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("bin", "and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.summed()
        kind, op = self.peek()
        if kind != "str" and op in ("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            return ("bin", op, tree, self.summed())
        if kind == "name" and op == "not":
            self.at += 1
            self.want("in")
            return ("not", ("bin", "in", tree, self.summed()))
        return tree

    def summed(self):
        tree = self.filtered()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.peek()[1]
            self.at += 1
            tree = ("bin", op, tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def reached(self):
        kind, text = self.peek()
        self.at += 1
        if kind == "str":
            tree = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        elif kind == "int":
            tree = ("const", int(text))
        elif kind == "name":
            tree = ("const", _CONSTANTS[text]) if text in _CONSTANTS else ("name", text)
        elif text == "(":
            tree = self.either()
            self.want(")")
        elif text == "-" and self.peek()[0] == "int":
            tree = ("const", -int(self.peek()[1]))
            self.at += 1
        else:
            raise TemplateError(f"unexpected {text!r}")
        while True:
            if self.take("."):
                key = self.name()
                if key.startswith("_"):
                    raise TemplateError(f"{key!r} can't be reached")
                tree = ("get", tree, ("const", key))
            elif self.take("["):
                tree = ("get", tree, self.either())
                self.want("]")
            else:
                return tree


def parse(source: str) -> list:
    """The statements of a template as a syntax tree."""
    pieces = iter(re.split(r"(\{%-?.*?-?%\}|\{\{.*?\}\})", source, flags=re.S))

    def body(ends: tuple[str, ...]) -> tuple[list, str]:
        out: list = []
        for piece in pieces:
            if piece.startswith("{{"):
                out.append(("out", _Expression(piece[2:-2]).whole()))
            elif not piece.startswith("{%"):
                out.append(("text", piece))
            else:
                inner = piece[2:-2].strip("-").strip()
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return out, inner
                if word == "if":
                    tests, other, test = [], [], rest
                    while True:
                        part, end = body(("elif", "else", "endif"))
                        tests.append((_Expression(test).whole(), part))
                        word, _, test = end.partition(" ")
                        if word == "else":
                            other, _ = body(("endif",))
                        if word != "elif":
                            break
                    out.append(("if", tests, other))
                elif word == "for":
                    e = _Expression(rest)
                    name = e.name()
                    e.want("in")
                    over = e.whole()
                    out.append(("for", name, over, body(("endfor",))[0]))
                elif word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not name.strip().isidentifier():
                        raise TemplateError(f"set needs a name and a value: {rest!r}")
                    out.append(("set", name.strip(), _Expression(value).whole()))
                elif word == "generation":
                    out.append(("gen", body(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unexpected statement {inner!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, ""

    return body(())[0]


def fold(tree):
    """The tree with constants folded."""
    if isinstance(tree, list):
        out: list = []
        for node in (x for t in tree for x in fold_statement(t)):
            if node[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node != ("text", ""):
                out.append(node)
        return out
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    parts = [fold(x) if isinstance(x, tuple) else x for x in tree]
    inner = [x for x in parts if isinstance(x, tuple)]
    if kind == "bin" and parts[1] in ("and", "or") and inner[0][0] == "const":
        return inner[1] if bool(inner[0][1]) == (parts[1] == "and") else inner[0]
    if all(x[0] == "const" for x in inner):
        return ("const", _expression(tuple(parts))({}))
    return tuple(parts)


def fold_statement(node) -> list:
    """What a statement becomes: no, one or several statements."""
    kind = node[0]
    if kind == "out":
        tree = fold(node[1])
        return [("text", "" if tree[1] is None else str(tree[1]))] if tree[0] == "const" else [("out", tree)]
    if kind == "if":
        tests, other = [], fold(node[2])
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            if test[0] == "const":
                other = fold(body)
                break
            tests.append((test, fold(body)))
        return [("if", tests, other)] if tests else other
    if kind == "for":
        return [("for", node[1], fold(node[2]), fold(node[3]))]
    if kind == "set":
        return [("set", node[1], fold(node[2]))]
    return [("gen", fold(node[1]))] if kind == "gen" else [node]


def _expression(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "get":
        value, key = _expression(tree[1]), _expression(tree[2])
        return lambda scope: _look_up(value(scope), key(scope))
    if kind == "not":
        value = _expression(tree[1])
        return lambda scope: not value(scope)
    if kind == "filter":
        value, f = _expression(tree[2]), FILTERS[tree[1]]
        return lambda scope: f(value(scope))
    left, right = _expression(tree[2]), _expression(tree[3])
    if tree[1] == "and":
        return lambda scope: left(scope) and right(scope)
    if tree[1] == "or":
        return lambda scope: left(scope) or right(scope)
    f = _BINARY[tree[1]]
    return lambda scope: f(left(scope), right(scope))


def _statements(body: list) -> Callable[[dict, list, list], None]:
    """A closure (scope, output pieces, generation spans as piece numbers)."""
    steps = [_statement(x) for x in body]

    def run(scope, out, spans):
        for step in steps:
            step(scope, out, spans)

    return steps[0] if len(steps) == 1 else run


def _statement(node) -> Callable[[dict, list, list], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, out, spans: out.append(text)
    if kind == "out":
        value = _expression(node[1])

        def put(scope, out, spans):
            v = value(scope)
            out.append(v if isinstance(v, str) else "" if v is None else str(v))

        return put
    if kind == "if":
        tests, other = [(_expression(t), _statements(b)) for t, b in node[1]], _statements(node[2])

        def choose(scope, out, spans):
            for test, then in tests:
                if test(scope):
                    return then(scope, out, spans)
            return other(scope, out, spans)

        return choose
    if kind == "for":
        name, over, each = node[1], _expression(node[2]), _statements(node[3])

        def loop(scope, out, spans):
            values = over(scope)
            values = values if isinstance(values, (list, tuple)) else []
            for i, v in enumerate(values):
                each(scope | {name: v, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(values) - 1}}, out, spans)

        return loop
    if kind == "set":
        name, value = node[1], _expression(node[2])
        return lambda scope, out, spans: scope.__setitem__(name, value(scope))
    inner = _statements(node[1])

    def generation(scope, out, spans):
        a = len(out)
        inner(scope, out, spans)
        spans.append((a, len(out)))

    return generation


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the text and the generation spans, in characters, ends excluded."""
    run = _statements(fold(parse(source)))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out: list[str] = []
        pieces: list[tuple[int, int]] = []
        run(dict(variables), out, pieces)
        ends = [0]
        for x in out:
            ends.append(ends[-1] + len(x))
        return "".join(out), [(ends[a], ends[b]) for a, b in pieces]

    return render


_TURN = re.compile(
    "|".join((r"\[INST\](?P<user>.*?)\[/INST\]", r"<s>(?P<assistant>.*?)</s>", r"<<SYS>>(?P<system>.*?)<</SYS>>", r"\[ROLE\](?P<role>.*?)\[/ROLE\]\[TEXT\](?P<text>.*?)\[/TEXT\]")), re.S
)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a text that DEFAULT_TEMPLATE made."""
    at = 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn begins at {at}")
        at = m.end()
        yield (unescape(m["role"]), unescape(m["text"])) if m["role"] is not None else (m.lastgroup, unescape(m[m.lastgroup]))


def format_conversations(turns: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<begin,end>>): one row per conversation, its rows in order of turn.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.  Null roles and texts count as empty, a
    null conv_id is a conversation of its own, rows with the same turn are ordered by role and text, repeated rows
    are repeated turns, no rows give no conversations.  One shuffle by conv_id brings a conversation together; it is
    one output text, so it has to fit a task by the data model.
    """
    render = compile_template(template)
    kind = turns.select("conv_id").schema[0].dataType.simpleString()
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def run(batches):
        for b in batches:
            texts, spans = [], []
            for rows in b.column(1).to_pylist():
                text, found = render({"messages": rows})
                texts.append(text)
                spans.append([{"begin": a, "end": z} for a, z in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], ["conv_id", "formatted", "loss_spans"])

    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<begin:int,end:int>>")


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from formatted texts and their loss spans."""
    kind = formatted.select("conv_id").schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = list(read_back(text))
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    out = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, out)
