"""Imports and symbols of JavaScript and TypeScript sources.

A tolerant scanner cuts a source into tokens (strings, templates with nested
expressions, comments and regular expressions are understood) and reads module
statements at nesting depth zero; calls of require and import count at any depth.
Markup inside sources is passed over as opaque tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|/\*.*\Z|^#![^\n]*)+", re.DOTALL)
_NAME = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$]*")
_NUMBER = re.compile(r"\.?\d[\w.]*")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.DOTALL)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_PUNCTUATION = re.compile(r"=>|\.\.\.|\?\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|.", re.DOTALL)
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "&&", "||", "??", "==", "===", "!=", "!==", "<=", ">=", "..."}
_WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "else", "do", "await", "yield", "default"}
_ESCAPES = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


@dataclass
class Analysis:
    exports: dict[str, None] = field(default_factory=dict)
    functions: dict[str, None] = field(default_factory=dict)
    classes: dict[str, None] = field(default_factory=dict)
    imports: list[tuple[str, str, list[str]]] = field(default_factory=list)
    parse_ok: bool = True


@dataclass(frozen=True)
class Token:
    kind: str  # name, string, number, regex, template, punct
    text: str
    line_start: bool = False


def _unquoted(raw: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code else _PLAIN.get(m[4], m[4])

    return _ESCAPES.sub(one, raw[1:-1])


def _template_end(source: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """The place after a template literal that starts at ``at``, and its expressions."""
    holes, i, n = [], at + 1, len(source)
    while i < n:
        c = source[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, holes
        elif source.startswith("${", i):
            depth, start = 1, i + 2
            i += 2
            while i < n and depth:
                c = source[i]
                if c in "'\"" and (m := _STRING.match(source, i)):
                    i = m.end()
                    continue
                if c == "`":
                    i, _ = _template_end(source, i)
                    continue
                if source.startswith(("//", "/*"), i) and (m := _SPACE.match(source, i)):
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
            holes.append((start, i - 1))
        else:
            i += 1
    return n, holes


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, n, fresh = 0, len(source), True
    while at < n:
        if m := _SPACE.match(source, at):
            fresh = fresh or "\n" in m[0]
            at = m.end()
            continue
        c = source[at]
        if m := _NAME.match(source, at):
            kind = "name"
        elif c in "'\"" and (m := _STRING.match(source, at)):
            kind = "string"
        elif c == "`":
            end, holes = _template_end(source, at)
            out.append(Token("template", source[at:end], fresh))
            for start, stop in holes:  # calls inside expressions count
                out.append(Token("punct", "("))
                out += tokens(source[start:stop])
                out.append(Token("punct", ")"))
            at, fresh = end, False
            continue
        elif m := _NUMBER.match(source, at):
            kind = "number"
        elif c == "/" and _regex_may_follow(out) and (m := _REGEX.match(source, at)):
            kind = "regex"
        else:
            m, kind = _PUNCTUATION.match(source, at), "punct"
        out.append(Token(kind, m[0], fresh))
        at, fresh = m.end(), False
    return out


def _regex_may_follow(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    return last.text in (_BEFORE_REGEX if last.kind == "punct" else _WORDS_BEFORE_REGEX if last.kind == "name" else ())


class _Reader:
    def __init__(self, source: str):
        self.t = tokens(source)
        self.found = Analysis()

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind != "string" else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def name(self, i: int) -> str | None:
        return self.t[i].text if self.kind(i) == "name" else _unquoted(self.t[i].text) if self.kind(i) == "string" else None

    def run(self) -> Analysis:
        depth, i, t = 0, 0, self.t
        start = True
        while i < len(t):
            token = t[i]
            if token.kind == "name":
                self._call(i)
                if depth == 0 and (start or token.line_start) and self.text(i - 1) != ".":
                    self._statement(i)
            if token.kind == "punct":
                depth += (token.text in ("(", "[", "{")) - (token.text in (")", "]", "}"))
                depth = max(depth, 0)
            start = token.kind == "punct" and token.text in (";", "}")
            i += 1
        if depth:
            self.found.parse_ok = False
        return self.found

    def _call(self, i: int) -> None:
        word = self.text(i)
        if word in ("require", "import") and self.text(i + 1) == "(" and self.kind(i + 2) == "string":
            if self.text(i - 1) in (".", "?.") or self.text(i - 1) == "function" or self.text(i + 3) not in (")", ","):
                return
            kind = "cjs" if word == "require" else "dynamic"
            self.found.imports.append((_unquoted(self.t[i + 2].text), kind, []))

    def _statement(self, i: int) -> None:
        word = self.text(i)
        if word == "import" and self.text(i + 1) not in ("(", "."):
            self._import(i + 1)
        elif word == "export":
            self._export(i + 1)
        elif word not in ("declare",):
            self._declaration(i, exported=False)

    def _braces(self, i: int, external: bool) -> tuple[list[str], int]:
        """Names in ``{ a, b as c }``: imported ones, or exported ones if not ``external``."""
        names: list[str] = []
        i += 1
        while i < len(self.t) and self.text(i) != "}":
            if self.text(i) == ",":
                i += 1
                continue
            if self.text(i) == "type" and self.text(i + 1) not in (",", "}", "as"):
                i += 1
            elif self.text(i) == "type" and self.text(i + 1) == "as" and self.text(i + 2) == "as":
                i += 0
            first = self.name(i)
            last = first
            i += 1
            if self.text(i) == "as":
                last = self.name(i + 1)
                i += 2
            chosen = first if external else last
            if chosen is not None:
                names.append(chosen)
            if self.text(i) not in (",", "}"):
                i += 1
        return names, i + 1

    def _import(self, i: int) -> None:
        if self.kind(i) == "string":
            self.found.imports.append((_unquoted(self.t[i].text), "static", []))
            return
        names: list[str] = []
        if self.text(i) in ("type", "typeof") and not (self.text(i + 1) in (",", "from") and self.text(i + 2) != "from"):
            i += 1
        while i < len(self.t):
            here = self.text(i)
            if here == "{":
                more, i = self._braces(i, external=True)
                names += more
            elif here == "*":
                names.append(f"* as {self.text(i + 2)}")
                i += 3
            elif here == ",":
                i += 1
            elif here == "from" and self.kind(i + 1) == "string":
                self.found.imports.append((_unquoted(self.t[i + 1].text), "static", names))
                return
            elif self.kind(i) == "name":
                names.append(here)
                i += 1
            else:
                return

    def _export(self, i: int) -> None:
        found, here = self.found, self.text(i)
        if here == "type" and self.text(i + 1) in ("{", "*"):
            i += 1
            here = self.text(i)
        if here == "*":
            if self.text(i + 1) == "as":
                if self.text(i + 3) == "from" and self.kind(i + 4) == "string":
                    found.imports.append((_unquoted(self.t[i + 4].text), "reexport", []))
            elif self.text(i + 1) == "from" and self.kind(i + 2) == "string":
                found.imports.append((_unquoted(self.t[i + 2].text), "reexport-all", []))
            return
        if here == "{":
            names, i = self._braces(i, external=False)
            if self.text(i) == "from" and self.kind(i + 1) == "string":
                found.imports.append((_unquoted(self.t[i + 1].text), "reexport", names))
            found.exports.update(dict.fromkeys(names))
            return
        if here == "default":
            found.exports["default"] = None
            i += 1
            if self.text(i) == "async" and self.text(i + 1) == "function":
                i += 1
            if self.text(i) == "abstract":
                i += 1
            if self.text(i) in ("function", "class"):
                into = found.functions if self.text(i) == "function" else found.classes
                i += 1 + (self.text(i + 1) == "*")
                if self.kind(i) == "name" and self.text(i) not in ("extends", "implements"):
                    into[self.text(i)] = None
            return
        self._declaration(i, exported=True)

    def _declaration(self, i: int, exported: bool) -> None:
        found = self.found
        while self.text(i) in ("declare", "abstract", "async") and self.kind(i + 1) == "name":
            if self.text(i) == "declare":
                if not exported:
                    return
                self._declared(i + 1)
                return
            i += 1
        here = self.text(i)
        if here in ("function", "class"):
            i += 1 + (self.text(i + 1) == "*")
            if self.kind(i) == "name":
                (found.functions if here == "function" else found.classes)[self.text(i)] = None
                if exported:
                    found.exports[self.text(i)] = None
        elif here in ("const", "let", "var"):
            if here == "const" and self.text(i + 1) == "enum":
                if exported and self.kind(i + 2) == "name":
                    found.exports[self.text(i + 2)] = None
                return
            self._variables(i + 1, exported)
        elif exported and here in ("interface", "type", "enum", "namespace", "module") and self.kind(i + 1) == "name":
            found.exports[self.text(i + 1)] = None

    def _declared(self, i: int) -> None:
        """Exported ambient declarations: types, classes and variables; functions have no body."""
        if self.text(i) in ("abstract", "async"):
            i += 1
        if self.text(i) == "const" and self.text(i + 1) == "enum":
            i += 1
        if self.text(i) in ("class", "interface", "type", "enum", "namespace", "module", "const", "let", "var") and self.kind(i + 1) == "name":
            self.found.exports[self.text(i + 1)] = None
            if self.text(i) == "class":
                self.found.classes[self.text(i + 1)] = None

    def _variables(self, i: int, exported: bool) -> None:
        """``a = ..., b: T = ...`` up to the end of the statement."""
        while self.kind(i) == "name" or self.text(i) in ("{", "["):
            name = self.text(i) if self.kind(i) == "name" else None
            i = self._skip(i) if name is None else i + 1
            if self.text(i) == ":":  # a type, up to = or , at its own depth
                i = self._until(i + 1, ("=", ",", ";"))
            value = i + 1 if self.text(i) == "=" else None
            if name is not None:
                if exported:
                    self.found.exports[name] = None
                if value is not None and self._is_function(value):
                    self.found.functions[name] = None
            if value is not None:
                i = self._until(value, (",", ";"))
            if self.text(i) != ",":
                return
            i += 1

    def _skip(self, i: int) -> int:
        """Past a bracketed group that starts at i."""
        depth = 0
        while i < len(self.t):
            depth += (self.text(i) in ("(", "[", "{")) - (self.text(i) in (")", "]", "}"))
            i += 1
            if depth == 0:
                break
        return i

    def _until(self, i: int, ends: tuple[str, ...]) -> int:
        """The first of ``ends`` at this depth, or a new statement on a new line."""
        angle, begin = 0, i
        while i < len(self.t):
            here = self.text(i)
            if here in ends and angle <= 0:
                return i
            if here in (")", "]", "}"):
                return i
            if i > begin and self.t[i].line_start and self.kind(i) == "name" and here in (
                "import", "export", "const", "let", "var", "function", "class", "async", "interface", "type", "enum", "declare",
            ) and self.text(i - 1) not in ("=", "(", ",", "=>", "?", ":", "return"):
                return i
            if "=" in ends or "=>" in ends:
                angle += (here == "<") - (here == ">")
            i = self._skip(i) if here in ("(", "[", "{") else i + 1
        return i

    def _is_function(self, i: int) -> bool:
        if self.text(i) == "async" and self.text(i + 1) != "=>":
            i += 1
        if self.text(i) == "function":
            return True
        if self.kind(i) == "name" and self.text(i + 1) == "=>":
            return True
        if self.text(i) == "<":  # type parameters of an arrow
            depth = 0
            while i < len(self.t):
                depth += (self.text(i) == "<") - (self.text(i) == ">")
                i += 1
                if depth == 0:
                    break
        if self.text(i) != "(":
            return False
        i = self._skip(i)
        if self.text(i) == ":":  # a return type
            i = self._until(i + 1, ("=>", ",", ";"))
        return self.text(i) == "=>"


def analyze(source: str) -> Analysis:
    """Symbols and imports; a source that cannot be read gives none and parse_ok = False."""
    try:
        return _Reader(source).run()
    except (RecursionError, IndexError, ValueError):
        return Analysis(parse_ok=False)


def strip_strings_and_comments(source: str) -> str:
    """The source without string literals, templates and comments."""
    out, at, n = [], 0, len(source)
    while at < n:
        c = source[at]
        if c in "'\"`":
            end = at + 1
            while end < n and source[end] != c:
                end += 2 if source[end] == "\\" else 1
            at = end + 1
        elif source.startswith("//", at):
            end = source.find("\n", at)
            at = n if end < 0 else end
        elif source.startswith("/*", at):
            end = source.find("*/", at + 2)
            at = n if end < 0 else end + 2
        else:
            out.append(c)
            at += 1
    return "".join(out)
