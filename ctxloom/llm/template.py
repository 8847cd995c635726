"""Compiler of a sandboxed template language for conversations.

    text {{ expression }} {% for m in messages %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %} {% generation %} ... {% endgeneration %} {# comment #}

Expressions know literals, names, fields of mappings (``m.role``, ``m['role']``),
``not and or == != < > <= >= in + - * %`` and filters (``e|trim``). Strings can be joined by
``+`` but not repeated or formatted, numbers stay under 2^63, and whatever goes wrong, in
parsing, folding or rendering, is a ``TemplateError``. There are no
calls, no attributes of objects and no imports, so a template reaches nothing but
the values it is given. A template is parsed to a syntax tree, constants are
folded (with dead branches and adjacent texts), and the tree becomes Python
closures. Rendering yields (piece, generated) pairs; ``generated`` is true inside
a generation block, which is what the loss mask covers.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(
    r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+\-*%|.()\[\]=]))""",
    re.DOTALL,
)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-"), ("*", "%"))
_MOST = 1 << 63


def _number(apply: Callable[[int, int], int]) -> Callable[[Any, Any], int]:
    """Arithmetic of whole numbers under 2^63; not the formatting or repetition of strings."""

    def run(a: Any, b: Any) -> int:
        if not isinstance(a, int) or not isinstance(b, int):
            raise TemplateError("not a number")
        if abs(out := apply(a, b)) >= _MOST:
            raise TemplateError("number out of range")
        return out

    return run


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, str) and isinstance(b, str) else _number(operator.add)(a, b)


def _guarded(apply: Callable) -> Callable:
    """The same, whose errors are the template's."""

    def run(*values: Any) -> Any:
        try:
            return apply(*values)
        except (TypeError, ValueError, ArithmeticError, AttributeError) as e:
            raise TemplateError(str(e)) from e

    return run


_APPLY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le,
    ">=": operator.ge, "+": _plus, "-": _number(operator.sub), "*": _number(operator.mul), "%": _number(operator.mod),
    "in": lambda a, b: a in b,
}
_APPLY = {op: _guarded(apply) for op, apply in _APPLY.items()}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "string": str,
}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 10]!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "str":
            value = re.sub(r"\\(.)", lambda e: _ESCAPE.get(e[1], e[1]), value[1:-1], flags=re.DOTALL)
        out.append((kind, value))
        at = m.end()
    return out


class _Expressions:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str:
        kind, value = self.peek()
        if wanted and (kind == "str" or value not in wanted):
            raise TemplateError(f"expected {' or '.join(wanted)}, found {value!r}")
        self.at += 1
        return value

    def all(self) -> Any:
        tree = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def level(self, n: int) -> Any:
        if n == len(_LEVELS):
            return self.postfix()
        if _LEVELS[n] == ("not",):
            if self.peek() == ("name", "not"):
                self.take()
                return Unary("not", self.level(n))
            return self.level(n + 1)
        left = self.level(n + 1)
        while self.peek()[0] in ("op", "name") and self.peek()[1] in _LEVELS[n]:
            op = self.take()
            left = Binary(op, left, self.level(n + 1))
        return left

    def postfix(self) -> Any:
        kind, value = self.peek()
        if kind == "str":
            self.at += 1
            tree: Any = Const(value)
        elif kind == "num":
            self.at += 1
            tree = Const(int(value))
        elif kind == "name":
            self.at += 1
            known = {"true": True, "false": False, "none": None}
            tree = Const(known[value]) if value in known else Name(value)
        elif (kind, value) == ("op", "-"):
            self.at += 1
            return Unary("-", self.postfix())
        else:
            self.take("(")
            tree = self.level(0)
            self.take(")")
        while self.peek()[0] == "op" and self.peek()[1] in (".", "[", "|"):
            op = self.take()
            if op == "[":
                tree = Field(tree, self.level(0))
                self.take("]")
                continue
            kind, name = self.peek()
            if kind != "name":
                raise TemplateError(f"expected a name after {op!r}")
            self.at += 1
            tree = Field(tree, Const(name)) if op == "." else Filter(tree, name)
        return tree


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, Any]] = []
    at = 0
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if pieces and pieces[-1][0] == "trim":
            pieces.pop()
            text = text.lstrip()
        if m[0].startswith(("{{-", "{%-")):
            text = text.rstrip()
        pieces.append(("text", text))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        if m[0].endswith(("-}}", "-%}")):
            pieces.append(("trim", None))
        at = m.end()
    rest = source[at:]
    if pieces and pieces[-1][0] == "trim":
        pieces.pop()
        rest = rest.lstrip()
    pieces.append(("text", rest))
    body, end = _body(iter(pieces), ())
    return body


def _body(pieces: Iterator[tuple[str, Any]], ends: tuple[str, ...]) -> tuple[tuple, str]:
    out: list[Any] = []
    for kind, value in pieces:
        if kind == "text":
            out.append(Text(value))
        elif kind == "out":
            out.append(Output(_Expressions(_tokens(value)).all()))
        elif kind == "tag":
            word, _, rest = value.partition(" ")
            if word in ends:
                return tuple(out), value
            out.append(_statement(word, rest, pieces))
    if ends:
        raise TemplateError(f"missing {' or '.join(ends)}")
    return tuple(out), ""


def _statement(word: str, rest: str, pieces: Iterator) -> Any:
    if word == "for":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
        if not m:
            raise TemplateError(f"bad loop: {rest!r}")
        body, _ = _body(pieces, ("endfor",))
        return For(m[1], _Expressions(_tokens(m[2])).all(), body)
    if word == "if":
        branches, condition = [], _Expressions(_tokens(rest)).all()
        while True:
            body, end = _body(pieces, ("elif", "else", "endif"))
            branches.append((condition, body))
            word, _, rest = end.partition(" ")
            if word == "elif":
                condition = _Expressions(_tokens(rest)).all()
                continue
            if word == "else":
                body, _ = _body(pieces, ("endif",))
                branches.append((Const(True), body))
            return If(tuple(branches))
    if word == "set":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.DOTALL)
        if not m:
            raise TemplateError(f"bad assignment: {rest!r}")
        return Set(m[1], _Expressions(_tokens(m[2])).all())
    if word == "generation":
        body, _ = _body(pieces, ("endgeneration",))
        return Generation(body)
    raise TemplateError(f"unknown tag {word!r}")


def fold(tree: Any, filters: dict[str, Callable]) -> Any:
    """The same expression with everything computed that needs no values."""
    match tree:
        case Unary(op, of):
            of = fold(of, filters)
            if isinstance(of, Const):
                return Const((not of.value) if op == "not" else _APPLY["-"](0, of.value))
            return Unary(op, of)
        case Binary(op, left, right):
            left, right = fold(left, filters), fold(right, filters)
            if isinstance(left, Const) and op in ("and", "or"):
                return right if bool(left.value) == (op == "and") else left
            if isinstance(left, Const) and isinstance(right, Const) and op in _APPLY:
                return Const(_APPLY[op](left.value, right.value))
            return Binary(op, left, right)
        case Filter(of, name):
            of = fold(of, filters)
            if name not in filters:
                raise TemplateError(f"unknown filter {name!r}")
            return Const(filters[name](of.value)) if isinstance(of, Const) else Filter(of, name)
        case Field(of, key):
            return Field(fold(of, filters), fold(key, filters))
    return tree


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def simplify(body: tuple, filters: dict[str, Callable]) -> tuple:
    """Statements with folded expressions, without dead branches, adjacent texts joined."""
    out: list[Any] = []

    def add(node: Any) -> None:
        if isinstance(node, Text):
            if not node.text:
                return
            if out and isinstance(out[-1], Text):
                node = Text(out.pop().text + node.text)
        out.append(node)

    for node in body:
        match node:
            case Output(of):
                of = fold(of, filters)
                add(Text(_shown(of.value)) if isinstance(of, Const) else Output(of))
            case Set(name, of):
                add(Set(name, fold(of, filters)))
            case For(name, over, inner):
                add(For(name, fold(over, filters), simplify(inner, filters)))
            case Generation(inner):
                add(Generation(simplify(inner, filters)))
            case If(branches):
                live = []
                for condition, inner in branches:
                    condition = fold(condition, filters)
                    if isinstance(condition, Const) and not condition.value:
                        continue
                    live.append((condition, simplify(inner, filters)))
                    if isinstance(condition, Const):
                        break
                if live and isinstance(live[0][0], Const):
                    for inner in live[0][1]:
                        add(inner)
                elif live:
                    add(If(tuple(live)))
            case _:
                add(node)
    return tuple(out)


Env = dict[str, Any]


def _value(tree: Any, filters: dict[str, Callable]) -> Callable[[Env], Any]:
    match tree:
        case Const(value):
            return lambda env: value
        case Name(name):
            return lambda env: env.get(name)
        case Field(of, Const(key)):
            get = _value(of, filters)
            return lambda env: x.get(key) if isinstance(x := get(env), dict) else None
        case Field(of, key):
            get, at = _value(of, filters), _value(key, filters)
            return lambda env: x.get(at(env)) if isinstance(x := get(env), dict) else None
        case Unary("not", of):
            get = _value(of, filters)
            return lambda env: not get(env)
        case Unary(_, of):
            get = _value(of, filters)
            return lambda env: _APPLY["-"](0, get(env))
        case Binary("and", left, right):
            a, b = _value(left, filters), _value(right, filters)
            return lambda env: a(env) and b(env)
        case Binary("or", left, right):
            a, b = _value(left, filters), _value(right, filters)
            return lambda env: a(env) or b(env)
        case Binary(op, left, right):
            a, b, apply = _value(left, filters), _value(right, filters), _APPLY[op]
            return lambda env: apply(a(env), b(env))
        case Filter(of, name):
            get, apply = _value(of, filters), filters[name]
            return lambda env: apply(get(env))
    raise TemplateError(f"no such expression: {tree!r}")


Pieces = Iterator[tuple[str, bool]]


def _looped(items: Iterable) -> Iterator[tuple[Any, dict]]:
    """Items with their loop variable; one item is held back to know the last."""
    source, index = iter(items), 0
    try:
        item = next(source)
    except StopIteration:
        return
    for after in source:
        yield item, {"index0": index, "index": index + 1, "first": index == 0, "last": False}
        item, index = after, index + 1
    yield item, {"index0": index, "index": index + 1, "first": index == 0, "last": True}


def _closure(body: tuple, generated: bool, filters: dict[str, Callable]) -> Callable[[Env], Pieces]:
    steps: list[Callable[[Env], Iterable[tuple[str, bool]]]] = []
    for node in body:
        steps.append(_step(node, generated, filters))

    def run(env: Env) -> Pieces:
        for step in steps:
            yield from step(env)

    return run


def _step(node: Any, generated: bool, filters: dict[str, Callable]) -> Callable[[Env], Iterable[tuple[str, bool]]]:
    match node:
        case Text(text):
            fixed = ((text, generated),)
            return lambda env: fixed
        case Output(of):
            get = _value(of, filters)
            return lambda env: ((_shown(get(env)), generated),)
        case Generation(inner):
            return _closure(inner, True, filters)
        case Set(name, of):
            get = _value(of, filters)

            def assign(env: Env) -> tuple:
                env[name] = get(env)
                return ()

            return assign
        case If(branches):
            tests = [(_value(c, filters), _closure(b, generated, filters)) for c, b in branches]

            def choose(env: Env) -> Iterable[tuple[str, bool]]:
                for test, run in tests:
                    if test(env):
                        return run(env)
                return ()

            return choose
        case For(name, over, inner):
            get, run = _value(over, filters), _closure(inner, generated, filters)

            def loop(env: Env) -> Pieces:
                for item, state in _looped(get(env) or ()):
                    yield from run(env | {name: item, "loop": state})

            return loop
    raise TemplateError(f"no such statement: {node!r}")


class Template:
    """A compiled template; ``render`` takes the values it may see."""

    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]] | None = None):
        known = {name: _guarded(apply) for name, apply in (FILTERS | (filters or {})).items()}
        self.tree = simplify(parse(source), known)
        self._run = _closure(self.tree, False, known)

    def render(self, **values: Any) -> Pieces:
        return self._run(dict(values))
