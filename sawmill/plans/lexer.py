"""Query text to tokens."""

from __future__ import annotations

from typing import NamedTuple

SINGLE = ":=,()"
LOGIC = {"and", "or", "not"}


class Token(NamedTuple):
    text: str
    quoted: bool = False

    @property
    def word(self) -> str | None:
        """and, or, not in any case; a quoted token is never an operator."""
        low = self.text.lower()
        return low if not self.quoted and low in LOGIC else None


def tokenize(text: str) -> list[Token]:
    """Split at spaces and tabs; each of ``: = , ( )`` is a token; double quotes hold a phrase together."""
    out: list[Token] = []
    word = ""
    i = 0

    def end() -> None:
        nonlocal word
        if word:
            out.append(Token(word))
            word = ""

    while i < len(text):
        c = text[i]
        if c == '"':
            close = text.find('"', i + 1)
            if close > i:
                end()
                out.append(Token(text[i + 1 : close], True))
                i = close + 1
                continue
            word += c
        elif c in " \t":
            end()
        elif c in SINGLE:
            end()
            out.append(Token(c))
        else:
            word += c
        i += 1
    end()
    return out


def has_logic(tokens: list[Token]) -> bool:
    return any(t.word for t in tokens)


def split_pipe(text: str) -> tuple[str, str | None]:
    """The search and the command behind the first pipe that is not in quotes (an option's ``|`` is not one)."""
    quoted = False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif c == "|" and not quoted and not text[i + 1 :].lstrip().lower().startswith(("strict", "ci")):
            return text[:i], text[i + 1 :]
    return text, None
