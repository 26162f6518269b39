"""Compiler of a sandboxed template language for conversations.

Source is cut into text, ``{{ expressions }}`` and ``{% tags %}``; parsed into a syntax tree; constants are
folded; and the tree becomes nested Python closures that yield (text, inside a generation block) pieces.
Nothing is evaluated as Python: names are the template's own variables, members are keys of a dict, calls
do not exist, filters are those of ``FILTERS``, and loops run over lists or the messages only.

Tags: for/endfor (with loop.index, loop.index0, loop.first, loop.last), if/elif/else/endif, set,
generation/endgeneration. A ``-`` next to a tag's mark strips white space on that side.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

Piece = tuple[str, bool]
Scope = dict[str, Any]
_CUT = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~|.,()\[\]<>%]))""", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The source is not a template, or it asks for what the sandbox does not have."""


# Control strings start with "<|". In a text, a backslash is doubled and "<|" becomes "<\|", so that none is left.
def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)), "escape_line": lambda x: escape_line(_text(x)), "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x) if isinstance(x, (str, list)) else 0,
}


def _text(x: Any) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


# Syntax tree: tuples ("kind", ...). Expressions: const, name, member, not, and, or, compare, add, concat, filter.
class _Expression:
    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at : at + 20]!r}")
            at = m.end()
            self.tokens.append(next((k, v) for k, v in zip(("number", "string", "name", "mark"), m.groups()) if v is not None))
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.joined()
        for mark in ("==", "!=", "<=", ">=", "<", ">"):
            if self.take(mark):
                return ("compare", mark, out, self.joined())
        return out

    def joined(self) -> tuple:
        out = self.filtered()
        while self.peek("+", "-", "~", "%"):
            mark = self.tokens[self.at][1]
            self.at += 1
            out = ("add", mark, out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.atom()
        while True:
            if self.take("."):
                out = ("member", out, ("const", self.name()))
            elif self.take("["):
                out = ("member", out, self.either())
                self.need("]")
            elif self.take("|"):
                if (name := self.name()) not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                out = ("filter", name, out)
            else:
                return out

    def atom(self) -> tuple:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("const", int(value))
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of text, out, for, if, set and generation nodes."""
    pieces, nodes = _CUT.split(source), []
    for k, piece in enumerate(pieces):
        if k % 2 == 0:
            before, after = pieces[k - 1] if k else "", pieces[k + 1] if k + 1 < len(pieces) else ""
            piece = piece.lstrip() if before.endswith(("-}}", "-%}")) else piece
            piece = piece.rstrip() if after.startswith(("{{-", "{%-")) else piece
            if "{%" in piece or "{{" in piece:
                raise TemplateError(f"a tag is not closed: {piece[:30]!r}")
            if piece:
                nodes.append(("text", piece))
        elif piece.startswith("{{"):
            nodes.append(("out", piece[2:-2].removeprefix("-").removesuffix("-")))
        elif piece.startswith("{%"):
            nodes.append(("tag", piece[2:-2].removeprefix("-").removesuffix("-").strip()))
    tree, at = _body(nodes, 0, ())
    if at < len(nodes):
        raise TemplateError(f"unexpected {nodes[at][1]!r}")
    return tree


def _body(nodes: list[tuple], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    out: list[tuple] = []
    while at < len(nodes):
        kind, value = nodes[at]
        if kind == "text":
            out.append(("text", value))
        elif kind == "out":
            out.append(("out", _Expression(value).whole()))
        else:
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, at
            if word == "for":
                of = _Expression(rest)
                name = of.name()
                of.need("in")
                over = of.whole()
                body, at = _body(nodes, at + 1, ("endfor",))
                out.append(("for", name, over, body))
            elif word == "generation":
                body, at = _body(nodes, at + 1, ("endgeneration",))
                out.append(("generation", body))
            elif word == "set":
                name, found, expression = rest.partition("=")
                if not found or not name.strip().isidentifier():
                    raise TemplateError(f"not a set tag: {rest!r}")
                out.append(("set", name.strip(), _Expression(expression).whole()))
            elif word == "if":
                cases, otherwise, condition = [], [], _Expression(rest).whole()
                while True:
                    body, at = _body(nodes, at + 1, ("elif", "else", "endif"))
                    cases.append((condition, body)) if condition is not None else otherwise.extend(body)
                    word, _, rest = nodes[at][1].partition(" ") if at < len(nodes) else ("", "", "")
                    if word in ("endif", ""):
                        break
                    if condition is None:
                        raise TemplateError(f"{word} after else")
                    condition = _Expression(rest).whole() if word == "elif" else None
                out.append(("if", cases, otherwise))
            else:
                raise TemplateError(f"no tag {word!r} here")
            if at >= len(nodes):
                raise TemplateError(f"{value!r} is not closed")
        at += 1
    if ends:
        return out, at
    return out, at


def fold(node: Any) -> Any:
    """The tree with constant expressions, branches and neighbouring texts replaced by what they come to."""
    if isinstance(node, list):
        out: list[tuple] = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return out
    kind = node[0]
    if kind == "out":
        inner = fold(node[1])
        return ("text", _text(inner[1])) if inner[0] == "const" else ("out", inner)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "if":
        cases, otherwise = [], fold(node[2])
        for condition, body in ((fold(c), fold(b)) for c, b in node[1]):
            if condition[0] != "const":
                cases.append((condition, body))
            elif condition[1]:
                otherwise = body
                break
        return ("if", cases, otherwise) if cases else otherwise
    if kind in ("text", "const", "name"):
        return node
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _value(parts)({}))
    return parts


def _value(node: tuple) -> Callable[[Scope], Any]:
    kind = node[0]
    if kind == "const":
        return lambda _, x=node[1]: x
    if kind == "name":
        return lambda scope, x=node[1]: scope.get(x)
    if kind == "member":
        of, key = _value(node[1]), _value(node[2])

        def member(scope: Scope) -> Any:
            x, k = of(scope), key(scope)
            if isinstance(x, dict):
                return x.get(k)
            return x[k] if isinstance(x, (list, str)) and isinstance(k, int) and -len(x) <= k < len(x) else None

        return member
    if kind == "filter":
        return lambda scope, f=FILTERS[node[1]], x=_value(node[2]): f(x(scope))
    if kind == "not":
        return lambda scope, x=_value(node[1]): not x(scope)
    a, b = map(_value, node[-2:])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "compare":
        return lambda scope, mark=node[1]: _compare(mark, a(scope), b(scope))
    return lambda scope, mark=node[1]: _join(mark, a(scope), b(scope))


def _compare(mark: str, a: Any, b: Any) -> bool:
    if mark in ("==", "!="):
        return (a == b) == (mark == "==")
    if not (isinstance(a, int) and isinstance(b, int) or isinstance(a, str) and isinstance(b, str)):
        return False
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[mark]


def _join(mark: str, a: Any, b: Any) -> Any:
    if mark == "~" or not (isinstance(a, int) and isinstance(b, int)):
        if mark in ("~", "+"):
            return _text(a) + _text(b)
        raise TemplateError(f"{mark!r} needs numbers")
    if mark == "%":
        return a % b if b else 0
    return a + b if mark == "+" else a - b


def _closure(body: list[tuple]) -> Callable[[Scope, bool], Iterator[Piece]]:
    steps = [_step(x) for x in body]

    def run(scope: Scope, marked: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, marked)

    return run


def _step(node: tuple) -> Callable[[Scope, bool], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":

        def text(_: Scope, marked: bool) -> Iterator[Piece]:
            yield node[1], marked

        return text
    if kind == "out":
        value = _value(node[1])

        def out(scope: Scope, marked: bool) -> Iterator[Piece]:
            yield _text(value(scope)), marked

        return out
    if kind == "set":
        value = _value(node[2])

        def put(scope: Scope, marked: bool) -> Iterator[Piece]:
            scope[node[1]] = value(scope)
            return iter(())

        return put
    if kind == "generation":
        body = _closure(node[1])
        return lambda scope, _: body(scope, True)
    if kind == "if":
        cases, otherwise = [(_value(c), _closure(b)) for c, b in node[1]], _closure(node[2])

        def choose(scope: Scope, marked: bool) -> Iterator[Piece]:
            yield from next((b for c, b in cases if c(scope)), otherwise)(scope, marked)

        return choose
    name, over, body = node[1], _value(node[2]), _closure(node[3])

    def loop(scope: Scope, marked: bool) -> Iterator[Piece]:
        items = over(scope)
        if isinstance(items, (str, dict)) or not isinstance(items, Iterable):
            return
        none = object()
        rest, k = iter(items), 0
        item = next(rest, none)
        while item is not none:
            after = next(rest, none)
            inner = scope | {name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is none}}
            yield from body(inner, marked)
            item, k = after, k + 1

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (dicts; any iterable, read once) to pieces of text with their generation mark.

    A template that uses ``messages`` once, as what a loop outside of all loops goes over, renders them as they
    come. Any other is given them as a list: it may go over them again, count them or pick some."""
    body = fold(parse(source))
    run, streams = _closure(body), _uses(body) == 1 and _outer_loops(body) == 1
    return lambda messages: run({"messages": messages if streams else list(messages)}, False)


def _uses(node: Any) -> int:
    """How often ``messages`` is named in a tree."""
    if isinstance(node, (list, tuple)):
        return 1 if tuple(node) == ("name", "messages") else sum(map(_uses, node))
    return 0


def _outer_loops(body: list[tuple]) -> int:
    """How many loops over ``messages`` stand in no other loop."""
    inside = {"for": lambda x: int(x[2] == ("name", "messages")), "if": lambda x: sum(_outer_loops(b) for _, b in x[1]) + _outer_loops(x[2]), "generation": lambda x: _outer_loops(x[1])}
    return sum(inside.get(x[0], lambda _: 0)(x) for x in body)
