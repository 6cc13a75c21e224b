"""Chat formatting with a compiled, sandboxed template language.

The language has text, `{{ expression }}`, `{% for x in e %}`, `{% if e %} / {% elif e %} / {% else %}`, `{% set x = e %}`,
`{% generation %}` (what stands inside is under the loss mask) and `{# comments #}`. Expressions have literals, names,
`a.b`, `a[b]`, `a + b`, `a ~ b`, `-a`, comparisons, `in`, `and`, `or`, `not`, `a if c else b` and the filters of FILTERS.
There are no calls and no attributes of Python objects (a dot only looks up keys), so templates can reach nothing
but their input. A template is parsed to a syntax tree, constants are folded, and the tree becomes Python closures.

A template whose top level is constant text around one loop over the messages, with a body that reads only its own message,
is rendered message by message; `format_conversations` then needs no conversation in memory. Other templates are
rendered for whole lists of messages by `Template.render`.

The template CHAT marks turns and replaces the two characters that control strings are made of ("<" and the backslash
of the replacements) inside roles and texts, so that `parse` gives back every turn exactly.

Defined results: null texts and roles are empty; rows are ordered by (turn, role, text), nulls first; repeated rows
are turns of their own; rows with a null conv_id form one conversation; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

CHAT = "{% for m in messages %}<turn>{{ m.role | guard }}<says>{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}</turn>\n{% endfor %}"


def guard(x) -> str:
    return str(x).replace("\\", "\\b").replace("<", "\\l")


def unguard(x: str) -> str:
    return x.replace("\\l", "<").replace("\\b", "\\")


FILTERS: dict[str, Callable] = {"guard": guard, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "string": str}


class TemplateError(ValueError):
    pass


# ---- reading: text -> tags -> tree -------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.()\[\],]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:]!r}")
        number, string, name, sign = m.groups()
        if number:
            out.append(("const", float(number) if "." in number else int(number)))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[0]), string[1:-1], flags=re.S)))
        elif name:
            out.append(("name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Reader:
    """Expressions by precedence climbing. Nodes: ("const", v), ("name", n), ("get", a, b), ("op", sign, a, b), ("not", a), ("neg", a), ("cond", c, a, b), ("filter", name, a)."""

    LEVELS = (("or",), ("and",), None, ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"))

    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self, *values) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def take(self, *values):
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)} at {self.tokens[self.at :]}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def full(self):
        e = self.conditional()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at :]}")
        return e

    def conditional(self):
        e = self.level(0)
        if self.peek("if"):
            self.take("if")
            c = self.level(0)
            self.take("else")
            return ("cond", c, e, self.conditional())
        return e

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.unary()
        if self.LEVELS[k] is None:
            if self.peek("not"):
                self.take("not")
                return ("not", self.level(k))
            return self.level(k + 1)
        e = self.level(k + 1)
        while self.peek(*self.LEVELS[k]) or (k == 3 and self.peek("not")):
            if self.peek("not"):
                self.take("not")
                self.take("in")
                e = ("not", ("op", "in", e, self.level(k + 1)))
            else:
                sign = self.take(*self.LEVELS[k])
                e = ("op", sign, e, self.level(k + 1))
        return e

    def unary(self):
        if self.peek("-"):
            self.take("-")
            return ("neg", self.unary())
        e = self.atom()
        while self.peek(".", "[", "|"):
            sign = self.take(".", "[", "|")
            if sign == "[":
                e = ("get", e, self.conditional())
                self.take("]")
            else:
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name" or sign == "|" and name not in FILTERS:
                    raise TemplateError(f"unknown filter or key {name!r}")
                self.at += 1
                e = ("get", e, ("const", name)) if sign == "." else ("filter", name, e)
        return e

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name":
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        if value == "(":
            e = self.conditional()
            self.take(")")
            return e
        raise TemplateError(f"unexpected {value!r}")


def _expression(source: str):
    return _Reader(_tokens(source)).full()


def parse_template(source: str) -> list:
    """Statement nodes: ("text", s), ("out", e), ("if", [(c, body)...]), ("for", name, e, body), ("set", name, e), ("gen", body)."""
    root: list = []
    stack: list[tuple[str, list, object]] = [("", root, None)]
    at = 0
    for m in _TAG.finditer(source):
        body = stack[-1][1]
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("out", _expression(m[1])))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            _statement(word, rest.strip(), stack)
    if source[at:]:
        stack[-1][1].append(("text", source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return root


def _statement(word: str, rest: str, stack: list) -> None:
    kind, body, node = stack[-1]
    if word == "for":
        name, _, e = rest.partition(" in ")
        if not name.strip().isidentifier():
            raise TemplateError(f"bad loop variable {name!r}")
        inner: list = []
        body.append(("for", name.strip(), _expression(e), inner))
        stack.append(("for", inner, None))
    elif word == "if":
        arms = [(_expression(rest), [])]
        body.append(("if", arms))
        stack.append(("if", arms[0][1], arms))
    elif word in ("elif", "else") and kind == "if":
        node.append((_expression(rest) if word == "elif" else ("const", True), []))
        stack[-1] = ("if", node[-1][1], node)
    elif word == "set":
        name, _, e = rest.partition("=")
        if not name.strip().isidentifier():
            raise TemplateError(f"bad name {name!r}")
        body.append(("set", name.strip(), _expression(e)))
    elif word == "generation":
        inner = []
        body.append(("gen", inner))
        stack.append(("generation", inner, None))
    elif word == f"end{kind}" and kind:
        stack.pop()
    else:
        raise TemplateError(f"unexpected {word!r}")


# ---- folding -----------------------------------------------------------------------------------------------------------

_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: f"{_text(a)}{_text(b)}",
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


def _text(x) -> str:
    return "" if x is None else str(x)


def _fold(e):
    kind = e[0]
    if kind in ("const", "name"):
        return e
    parts = [_fold(x) if isinstance(x, tuple) else x for x in e[1:]]
    consts = [x[1] for x in parts if isinstance(x, tuple) and x[0] == "const"]
    if kind == "cond" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind == "op" and parts[0] in ("and", "or") and parts[1][0] == "const":
        return parts[2] if bool(parts[1][1]) == (parts[0] == "and") else parts[1]
    if len(consts) == sum(isinstance(x, tuple) for x in parts):
        try:
            return ("const", _closure((kind, *parts))({}))
        except Exception:  # left for the time of rendering, as the branch may never be taken
            pass
    return (kind, *parts)


def fold(nodes: list) -> list:
    out: list = []

    def add(n) -> None:
        if n[0] == "text" and out and out[-1][0] == "text":
            n = ("text", out.pop()[1] + n[1])
        if n != ("text", ""):
            out.append(n)

    for n in nodes:
        if n[0] == "out":
            e = _fold(n[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        elif n[0] == "if":
            arms = []
            for c, body in n[1]:
                c = _fold(c)
                if c[0] != "const" or c[1]:
                    arms.append((c, fold(body)))
                if c[0] == "const" and c[1]:
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        elif n[0] == "for":
            add(("for", n[1], _fold(n[2]), fold(n[3])))
        elif n[0] == "set":
            add(("set", n[1], _fold(n[2])))
        elif n[0] == "gen":
            add(("gen", fold(n[1])))
        else:
            add(n)
    return out


# ---- closures ----------------------------------------------------------------------------------------------------------


def _lookup(a, b):
    if isinstance(a, dict):
        return a.get(b)
    if isinstance(a, (list, str)) and isinstance(b, int):
        return a[b] if -len(a) <= b < len(a) else None
    return None


def _closure(e) -> Callable:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "get":
        a, b = _closure(e[1]), _closure(e[2])
        return lambda env: _lookup(a(env), b(env))
    if kind == "not":
        a = _closure(e[1])
        return lambda env: not a(env)
    if kind == "neg":
        a = _closure(e[1])
        return lambda env: -a(env)
    if kind == "cond":
        c, a, b = map(_closure, e[1:])
        return lambda env: a(env) if c(env) else b(env)
    if kind == "filter":
        f, a = FILTERS[e[1]], _closure(e[2])
        return lambda env: f(a(env))
    a, b = _closure(e[2]), _closure(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    f = _OPS[e[1]]
    return lambda env: f(a(env), b(env))


def _writer(nodes: list) -> Callable:
    """A function (env, parts, masked) that appends (text, under mask) pairs to parts."""
    steps = [_step(n) for n in nodes]

    def run(env, parts, masked):
        for s in steps:
            s(env, parts, masked)

    return run


def _step(n) -> Callable:
    if n[0] == "text":
        return lambda env, parts, masked, s=n[1]: parts.append((s, masked))
    if n[0] == "out":
        e = _closure(n[1])
        return lambda env, parts, masked: parts.append((_text(e(env)), masked))
    if n[0] == "set":
        e = _closure(n[2])
        return lambda env, parts, masked, k=n[1]: env.__setitem__(k, e(env))
    if n[0] == "gen":
        body = _writer(n[1])
        return lambda env, parts, masked: body(env, parts, True)
    if n[0] == "if":
        arms = [(_closure(c), _writer(body)) for c, body in n[1]]

        def choose(env, parts, masked):
            for c, body in arms:
                if c(env):
                    body(env, parts, masked)
                    return

        return choose
    name, items, body = n[1], _closure(n[2]), _writer(n[3])

    def loop(env, parts, masked):
        values = list(items(env) or ())
        inner = dict(env)
        for i, v in enumerate(values):
            inner[name] = v
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(values) - 1, "length": len(values)}
            body(inner, parts, masked)

    return loop


def _names(n) -> set[str]:
    """Names that a tree reads or sets."""
    if isinstance(n, tuple) and len(n) == 2 and n[0] == "name":
        return {n[1]}
    found = {n[1]} if isinstance(n, tuple) and n and n[0] == "set" else set()
    for x in n if isinstance(n, (tuple, list)) else ():
        if isinstance(x, (tuple, list)):
            found |= _names(x)
    return found


class Template:
    """A compiled template. `separable`: whether it can be rendered message by message, between `head` and `tail`."""

    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse_template(source))
        self._all = _writer(self.tree)
        loops = [n for n in self.tree if n[0] == "for"]
        self.separable = len(loops) == 1 and all(n[0] in ("for", "text") for n in self.tree) and loops[0][2] == ("name", "messages") and _names(loops[0][3]) <= {loops[0][1]}
        if self.separable:
            at = self.tree.index(loops[0])
            self.head, self.tail = ("".join(n[1] for n in x) for x in (self.tree[:at], self.tree[at + 1 :]))
            self._name, self._one = loops[0][1], _writer(loops[0][3])

    def render(self, messages: list[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of it (in characters) under the loss mask."""
        parts: list = []
        self._all({**names, "messages": messages}, parts, False)
        return _joined(parts)

    def render_one(self, message: dict) -> tuple[str, list[tuple[int, int]]]:
        parts: list = []
        self._one({self._name: message}, parts, False)
        return _joined(parts)


def _joined(parts: list) -> tuple[str, list[tuple[int, int]]]:
    spans: list[tuple[int, int]] = []
    at = 0
    for s, masked in parts:
        if masked and s:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(s))
            else:
                spans.append((at, at + len(s)))
        at += len(s)
    return "".join(s for s, _ in parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) turns of what CHAT wrote."""
    turns = []
    for piece in text.split("</turn>\n")[:-1]:
        role, _, said = piece.removeprefix("<turn>").partition("<says>")
        turns.append((unguard(role), unguard(said)))
    return turns


# ---- conversations -----------------------------------------------------------------------------------------------------

_PIECE = "conv_id bigint, part bigint, seq bigint, whole boolean, text string, spans array<struct<s:bigint,e:bigint>>"
_PIECE_BYTES = 1 << 18


def format_conversations(rows: DataFrame, template: str = CHAT, piece_chars: int = _PIECE_BYTES) -> DataFrame:
    """Formatted conversations as pieces (conv_id, part, seq, text, spans): the pieces of a conversation, in the order of (part, seq), joined, are its text; spans are relative to the piece.

    Rows are range-partitioned by (conv_id, turn, role, text), so a conversation of any size is spread over tasks. Turns are
    rendered one by one and joined to pieces of about piece_chars. `whole` marks a conversation that surely stands in
    one piece; the first and last of each partition may go on in the next.
    """
    t = Template(template)
    if not t.separable or t.head or t.tail:
        raise TemplateError("only templates that are one loop over the messages can be rendered in pieces")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    said = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    dealt = rows.select("conv_id", "turn", *said).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]):
        t = Template(template)
        out: list = []
        state: dict = {"conv": None, "open": False, "n": 0, "first": True, "seq": 0}
        text: list[str] = []
        spans: list[dict] = []
        size = 0

        def flush(end_of_conversation: bool, last: bool) -> None:
            nonlocal size
            whole = end_of_conversation and state["seq"] == 0 and not state["first"] and not last
            out.append((state["conv"], state["part"], state["seq"], whole, "".join(text), list(spans)))
            text.clear()
            spans.clear()
            size = 0
            state["seq"] += 1

        def batch_of(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "part", "seq", "whole", "text", "spans"])

        for batch in batches:
            for part, conv, role, said in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "role", "text")), strict=True):
                if not state["open"] or conv != state["conv"]:
                    if state["open"]:
                        flush(True, False)
                        state["first"] = False
                    state.update(conv=conv, part=part, seq=0, open=True)
                elif size >= piece_chars:
                    flush(False, False)
                s, marks = t.render_one({"role": role, "text": said})
                spans.extend({"s": a + size, "e": b + size} for a, b in marks)
                text.append(s)
                size += len(s)
            if len(out) > 0 and sum(len(x[4]) for x in out) >= 8 * piece_chars:
                yield batch_of(out)
                out.clear()
        if state["open"]:
            flush(True, True)
        if out:
            yield batch_of(out)

    return dealt.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, _PIECE)


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _ReadBack:
    """Reads the pieces of one conversation in order and keeps running digests, not texts."""

    def __init__(self, conv):
        self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for role, said in parse(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for x in spans:
            s = unguard(text[x["s"] : x["e"]])
            self.loss += len(s)
            self.masked.update(s.encode())

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from formatted pieces.

    Whole pieces are read where they are. Only conversations that may cross partitions are brought together, one stream
    of pieces after another; a digest of one sequence has to read it in order, but holds one piece at a time.
    """

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for conv, part, seq, whole, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or whole or now.conv != conv or now.alone:
                    if now is not None:
                        rows.append(now.row())
                    now = _ReadBack(conv)
                    now.alone = whole
                now.add(text, spans)
            if rows:
                yield _rows(rows)
        if now is not None:
            yield _rows([now.row()])

    def _rows(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    alone = pieces.filter("whole").mapInArrow(run, _DIGEST)
    rest = pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")
    return alone.unionByName(rest.mapInArrow(run, _DIGEST))


def op2(spark, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(stash(format_conversations(rows.unionByName(extra))))


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(r) + length(r) - length(replace(r, '\', '')) + length(r) - length(replace(r, '<', ''))
             + length(t) + length(t) - length(replace(t, '\', '')) + length(t) - length(replace(t, '<', '')) + 20 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       cast(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256, cast(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
