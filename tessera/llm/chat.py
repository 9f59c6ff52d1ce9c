"""Chat formatting with a small sandboxed template language.

A template is parsed to a syntax tree, constants are folded, and the tree becomes Python closures; nothing is ever
evaluated as Python.  The language has text, ``{{ expression }}`` and the blocks

    {% for name in name %} ... {% endfor %}
    {% if expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}      text under the loss mask

Expressions are names, fields (``turn.role``), strings, integers, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not``,
parentheses and filters (``| escape``, ``| upper``, ``| lower``, ``| trim``).  A loop takes its items one by one, so a
conversation of any length streams through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# ---------------------------------------------------------------------------------------------------------------- text

TURN, END = "### ", "</turn>"
# Every control string and what stands for it inside a text (fixed by the format; reversible).
_ESCAPES = {"\\": "\\\\", "###": "\\###", END: "\\" + END}
_ROLE_ESCAPES = {**_ESCAPES, "\n": "\\n"}


def escape(text: str, table: dict[str, str] = _ESCAPES) -> str:
    return re.sub("|".join(map(re.escape, table)), lambda m: table[m[0]], text)


def unescape(text: str, table: dict[str, str] = _ESCAPES) -> str:
    back = {v: k for k, v in table.items()}
    return re.sub("|".join(map(re.escape, back)), lambda m: back[m[0]], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_role": lambda t: escape(t, _ROLE_ESCAPES), "upper": str.upper, "lower": str.lower, "trim": str.strip,
}

TEMPLATE = (
    "{% for turn in turns %}{{ '### ' + (turn.role | escape_role) + '\n' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}{{ '</turn>' + '\n' }}{% endfor %}"
)

# ------------------------------------------------------------------------------------------------------------ compiler

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEX = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)"
                  r"|(?P<op>==|!=|[+|().])|(?P<bad>\S))", re.S)
_BACKSLASH = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


def lex(source: str) -> list[tuple[str, str]]:
    found = []
    for m in _LEX.finditer(source):
        if m["bad"]:
            raise TemplateError(f"unexpected {m['bad']!r} in {source!r}")
        kind = m.lastgroup
        found.append((kind, m[kind]))
    return found


class ExpressionParser:
    """Precedence, weakest first: or, and, not, == !=, +, filters, fields."""

    def __init__(self, source: str):
        self.tokens, self.at, self.source = lex(source), 0, source

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.at += 1
            return True
        return False

    def whole(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return tree

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.added()
        while self.peek() in (("op", "=="), ("op", "!=")):
            op = self.peek()[1]
            self.at += 1
            left = (op, left, self.added())
        return left

    def added(self):
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self):
        left = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            left = ("filter", name, left)
        return left

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "string":
            tree = ("constant", re.sub(r"\\(.)", lambda m: _BACKSLASH.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            tree = ("constant", int(value))
        elif kind == "name":
            tree = ("name", value)
        elif (kind, value) == ("op", "("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f"missing ) in {self.source!r}")
        else:
            raise TemplateError(f"an expression is missing in {self.source!r}")
        while self.take("."):
            kind, value = self.peek()
            if kind != "name":
                raise TemplateError(f"a field name is missing in {self.source!r}")
            self.at += 1
            tree = ("field", tree, value)
        return tree


def parse(source: str) -> list:
    """Template text to a list of nodes: ("text", s), ("put", e), ("for", name, e, body), ("if", e, yes, no), ("mask", body)."""
    stack: list[tuple[str, tuple, list]] = [("", (), [])]
    at = 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            stack[-1][2].append(("text", source[at:m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(("put", ExpressionParser(m[1]).whole()))
            continue
        tag, _, rest = m[2].strip().partition(" ")
        if tag == "for":
            names = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not names:
                raise TemplateError(f"a loop needs 'name in expression': {rest!r}")
            stack.append(("for", (names[1], ExpressionParser(names[2]).whole()), []))
        elif tag == "if":
            stack.append(("if", (ExpressionParser(rest).whole(),), []))
        elif tag == "generation":
            stack.append(("generation", (), []))
        elif tag == "else" and stack[-1][0] == "if":
            _, head, body = stack.pop()
            stack.append(("else", (*head, body), []))
        elif tag == "endfor" and stack[-1][0] == "for":
            _, head, body = stack.pop()
            stack[-1][2].append(("for", *head, body))
        elif tag == "endif" and stack[-1][0] in ("if", "else"):
            kind, head, body = stack.pop()
            stack[-1][2].append(("if", head[0], *((body, []) if kind == "if" else (head[1], body))))
        elif tag == "endgeneration" and stack[-1][0] == "generation":
            stack[-2][2].append(("mask", stack.pop()[2]))
        else:
            raise TemplateError(f"unexpected block {tag!r}")
    if len(stack) > 1:
        raise TemplateError(f"block {stack[-1][0]!r} is not closed")
    if at < len(source):
        stack[0][2].append(("text", source[at:]))
    return stack[0][2]


def fold(tree):
    """Constant parts of an expression become one constant; in a sum also the constants beside each other."""
    kind = tree[0]
    if kind in ("constant", "name"):
        return tree
    if kind == "field":
        return ("field", fold(tree[1]), tree[2])
    if kind == "filter":
        inner = fold(tree[2])
        return ("constant", FILTERS[tree[1]](str(inner[1]))) if inner[0] == "constant" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold(tree[1])
        return ("constant", not inner[1]) if inner[0] == "constant" else ("not", inner)
    left, right = fold(tree[1]), fold(tree[2])
    if left[0] == right[0] == "constant":
        return ("constant", evaluator((kind, left, right))({}))
    if kind == "+" and right[0] == "constant" and left[0] == "+" and left[2][0] == "constant" \
            and isinstance(right[1], str) and isinstance(left[2][1], str):
        return ("+", left[1], ("constant", left[2][1] + right[1]))
    return (kind, left, right)


def fold_nodes(nodes: list) -> list:
    """Fold every expression, drop branches that never run, and join constant text beside constant text."""
    out: list = []
    for node in nodes:
        kind = node[0]
        if kind == "put":
            tree = fold(node[1])
            node = ("text", str(tree[1])) if tree[0] == "constant" else ("put", tree)
        elif kind == "for":
            node = ("for", node[1], fold(node[2]), fold_nodes(node[3]))
        elif kind == "mask":
            node = ("mask", fold_nodes(node[1]))
        elif kind == "if":
            test, yes, no = fold(node[1]), fold_nodes(node[2]), fold_nodes(node[3])
            if test[0] == "constant":
                parts = yes if test[1] else no
                for p in parts:
                    _push(out, p)
                continue
            node = ("if", test, yes, no)
        _push(out, node)
    return out


def _push(out: list, node) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def evaluator(tree) -> Callable[[dict], object]:
    """A closure over the scope; names and fields are looked up in mappings only."""
    kind = tree[0]
    if kind == "constant":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]

        def look(scope):
            if name not in scope:
                raise TemplateError(f"unknown name {name!r}")
            return scope[name]
        return look
    if kind == "field":
        inner, name = evaluator(tree[1]), tree[2]

        def field(scope):
            value = inner(scope)
            if not isinstance(value, dict) or name not in value:
                raise TemplateError(f"no field {name!r}")
            return value[name]
        return field
    if kind == "filter":
        change, inner = FILTERS[tree[1]], evaluator(tree[2])
        return lambda scope: change(str(inner(scope)))
    if kind == "not":
        inner = evaluator(tree[1])
        return lambda scope: not inner(scope)
    left, right = evaluator(tree[1]), evaluator(tree[2])
    if kind == "+":
        def add(scope):
            a, b = left(scope), right(scope)
            return a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}"
        return add
    return {
        "==": lambda scope: left(scope) == right(scope), "!=": lambda scope: left(scope) != right(scope),
        "and": lambda scope: left(scope) and right(scope), "or": lambda scope: left(scope) or right(scope),
    }[kind]


def generator(nodes: list, masked: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """Nodes to a closure that yields (piece, under the loss mask) pairs."""
    steps: list[Callable[[dict], Iterator[tuple[str, bool]]]] = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda scope, piece=node[1]: iter(((piece, masked),)))
        elif kind == "put":
            steps.append(lambda scope, value=evaluator(node[1]): iter(((str(value(scope)), masked),)))
        elif kind == "mask":
            steps.append(generator(node[1], True))
        elif kind == "if":
            def choose(scope, test=evaluator(node[1]), yes=generator(node[2], masked), no=generator(node[3], masked)):
                return yes(scope) if test(scope) else no(scope)
            steps.append(choose)
        else:
            def loop(scope, name=node[1], items=evaluator(node[2]), body=generator(node[3], masked)):
                for item in items(scope):
                    yield from body({**scope, name: item})
            steps.append(loop)

    def run(scope):
        for step in steps:
            yield from step(scope)
    return run


def compile_template(source: str = TEMPLATE) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """Turns (dicts with role and text) to an iterator of (piece, under the loss mask)."""
    run = generator(fold_nodes(parse(source)))
    return lambda turns: run({"turns": turns})


# ----------------------------------------------------------------------------------------------------------- operators

# Formatted text of a conversation leaves in pieces of about this many characters.
PIECE_CHARS = 200_000

_FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _rows(batches, names):
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))], schema=schema)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Render conversations: (conv_id, piece, start, text, spans), the pieces of one conversation in order.

    ``start`` is the piece's place in the conversation's formatted text, ``spans`` the loss mask, in code points of that
    whole text.  Turns are dealt by conversation and sorted; a task holds one piece of one conversation at a time.
    Order: turn, then role, then text, nulls first; repeated rows stay.  Null role or text: empty.  A null conv_id is a
    conversation of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    compile_template(template)  # errors show here, not in a task
    dealt = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                          F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
             .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches):
        schema, render, out, held = to_arrow_schema(_FORMATTED), compile_template(template), [], 0
        for conv, rows in groupby(_rows(batches, ("conv_id", "role", "text")), key=lambda r: r[0]):
            parts, spans, start, at, piece = [], [], 0, 0, 0
            for text, masked in render({"role": r[1], "text": r[2]} for r in rows):
                if at - start >= piece_chars:
                    out.append((conv, piece, start, "".join(parts), spans))
                    held += at - start
                    parts, spans, start, piece = [], [], at, piece + 1
                if masked and text:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] = at + len(text)
                    else:
                        spans.append({"start": at, "end": at + len(text)})
                parts.append(text)
                at += len(text)
                if held >= 4 * piece_chars:
                    yield _arrow(out, schema)
                    out, held = [], 0
            out.append((conv, piece, start, "".join(parts), spans))
            held += at - start + 100
        if out:
            yield _arrow(out, schema)

    return dealt.mapInArrow(run, _FORMATTED)


_DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


def read_turns(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn from formatted text of the default template, which may come cut anywhere."""
    text = ""
    for piece in pieces:
        text += piece
        at = 0
        while (end := _turn_end(text, at)) is not None:
            head, _, body = text[at + len(TURN):end].partition("\n")
            yield unescape(head, _ROLE_ESCAPES), unescape(body)
            at = end + len(END) + 1
        text = text[at:]
    if text:
        raise ValueError("the formatted text ends inside a turn")


def _turn_end(text: str, at: int) -> int | None:
    """Place of the next end marker that no escape covers; none if the text may go on."""
    found = text.find(END + "\n", at)
    while found >= 0:
        slashes = found - len(text[at:found].rstrip("\\")) - at
        if slashes % 2 == 0:
            return found
        found = text.find(END + "\n", found + 1)
    return None


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the formatted pieces and their masks alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches):
        schema, out = to_arrow_schema(_DIGEST), []
        for conv, rows in groupby(_rows(batches, ("conv_id", "start", "text", "spans")), key=lambda r: r[0]):
            turns, loss, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0

            def pieces():
                nonlocal chars, size
                for _, start, text, spans in rows:
                    size += len(text)
                    for s in spans:
                        got = unescape(text[s["start"] - start:s["end"] - start])
                        chars += len(got)
                        loss.update(got.encode("utf-8", "surrogatepass"))
                    yield text

            n = 0
            for role, text in read_turns(pieces()):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(out) >= 1000:
                yield _arrow(out, schema)
                out = []
        if out:
            yield _arrow(out, schema)

    return ordered.mapInArrow(run, _DIGEST)
