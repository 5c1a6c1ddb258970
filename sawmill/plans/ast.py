"""Search trees and their parser: NOT binds before AND, AND before OR; adjacent operands are ANDed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.timeparse import literal_ms
from .lexer import Token, has_logic, tokenize


class Node:
    pass


@dataclass(frozen=True)
class All(Node):
    """Every line."""


@dataclass(frozen=True)
class Phrase(Node):
    """Tokens in order; one token is a term or a wildcard."""

    tokens: tuple[str, ...]


@dataclass(frozen=True)
class FieldMatch(Node):
    """``alias:value`` with its options."""

    name: str
    value: str
    strict: bool = False
    ci: bool = False


@dataclass(frozen=True)
class FieldCompare(Node):
    """``alias:>=5`` or ``alias:1..9`` (op ``..``)."""

    name: str
    op: str
    low: int
    high: int | None = None


@dataclass(frozen=True)
class Regex(Node):
    pattern: str


@dataclass(frozen=True)
class TimeRange(Node):
    start: int | None
    end: int | None


@dataclass(frozen=True)
class Not(Node):
    of: Node


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...] = field(default_factory=tuple)


class QueryError(ValueError):
    pass


_TIME = re.compile(r"-time\s+(\"[^\"]*\"|\S+)\s+(\"[^\"]*\"|\S+)")
_OPTION = re.compile(r"\|\s*(strict|ci)\b")
_NUMERIC = re.compile(r"^(==|!=|>=|<=|>|<)?(-?\d+)$")
_RANGE = re.compile(r"^(-?\d+)\.\.(-?\d+)$")


def parse(text: str, fields: set[str] | None = None, piped: bool = False) -> Node:
    """A search. ``fields``: known aliases (lower case), so that ``host:x`` is a field filter and ``12:30`` is not.

    Without ``piped``, several words without any operator are ANDed; in front of a pipe they are one phrase.
    """
    parts: list[Node] = []
    m = _TIME.search(text)
    if m:
        bounds = [literal_ms(x.strip('"')) for x in m.groups()]
        if None in bounds:
            raise QueryError(f"bad time range: {m[0]}")
        parts.append(TimeRange(*bounds))
        text = text[: m.start()] + " " + text[m.end() :]
    options = {x.lower() for x in _OPTION.findall(text)}
    text = _OPTION.sub(" ", text)
    tokens = _fields(tokenize(text), {f.lower() for f in fields or ()}, options)
    if not tokens:
        tree: Node = All()
    elif not has_logic([t for t in tokens if isinstance(t, Token)]) and not piped and not any(isinstance(t, Token) and t.text in "()" and not t.quoted for t in tokens):
        tree = _all_of([t if isinstance(t, Node) else _leaf([t]) for t in tokens])
    else:
        tree = _Parser(tokens).parse()
    return _all_of([*parts, tree]) if parts and not isinstance(tree, All) else (_all_of(parts) if parts else tree)


def _all_of(parts: list[Node]) -> Node:
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def _leaf(tokens: list[Token]) -> Node:
    words: list[str] = []
    for t in tokens:
        if t.quoted:
            words += [x.text for x in tokenize(t.text)]
        else:
            words.append(t.text)
    if len(words) == 1 and len(words[0]) > 2 and words[0][0] == words[0][-1] == "/" and not tokens[0].quoted:
        return Regex(words[0][1:-1])
    return Phrase(tuple(words))


def _fields(tokens: list[Token], known: set[str], options: set[str]) -> list:
    """Replace ``alias : value`` by field nodes."""
    out: list = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if not t.quoted and t.text.lower() in known and i + 2 < len(tokens) + 0 and tokens[i + 1].text == ":" and not tokens[i + 1].quoted:
            value, i = tokens[i + 2].text, i + 3
            if value in {">", "<", "!"} or (value == "=" and i < len(tokens)):  # '=' is a token of its own
                while i < len(tokens) and (value[-1:] in "=<>!") and not tokens[i].quoted and tokens[i].text not in "()":
                    value, i = value + tokens[i].text, i + 1
            while value in {">", "<", "!", ">=", "<=", "=", "==", "!="} and i < len(tokens):
                value, i = value + tokens[i].text, i + 1
            out.append(_field(t.text.lower(), value, options))
            continue
        out.append(t)
        i += 1
    return out


def _field(name: str, value: str, options: set[str]) -> Node:
    if m := _RANGE.match(value):
        return FieldCompare(name, "..", int(m[1]), int(m[2]))
    if (m := _NUMERIC.match(value)) and m[1]:
        return FieldCompare(name, m[1], int(m[2]))
    return FieldMatch(name, value, "strict" in options, "ci" in options)


class _Parser:
    def __init__(self, tokens: list):
        self.tokens, self.at = tokens, 0

    def _peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _is(self, text: str) -> bool:
        t = self._peek()
        return isinstance(t, Token) and not t.quoted and (t.word == text or t.text == text)

    def parse(self) -> Node:
        tree = self._or()
        if self._peek() is not None:
            raise QueryError(f"unexpected {self._peek().text!r}")
        return tree

    def _or(self) -> Node:
        parts = [self._and()]
        while self._is("or"):
            self.at += 1
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def _and(self) -> Node:
        parts = [self._unary()]
        while (t := self._peek()) is not None and not self._is("or") and not self._is(")"):
            if self._is("and"):
                self.at += 1
            parts.append(self._unary())
            del t
        return _all_of(parts)

    def _unary(self) -> Node:
        if self._is("not"):
            self.at += 1
            return Not(self._unary())
        if self._is("("):
            self.at += 1
            tree = self._or()
            if not self._is(")"):
                raise QueryError("missing )")
            self.at += 1
            return tree
        t = self._peek()
        if isinstance(t, Node):
            self.at += 1
            return t
        run: list[Token] = []
        while isinstance(t := self._peek(), Token) and not t.word and not (t.text in "()" and not t.quoted):
            run.append(t)
            self.at += 1
        if not run:
            raise QueryError("an operand is missing")
        return _leaf(run)
