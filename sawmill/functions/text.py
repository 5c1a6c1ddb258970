"""String predicates as Catalyst expressions: terms, wildcards, phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between tokens of a line.
DELIMITERS = " \t:=,"
_DELIMITER_RUN = "[ \\t:=,]+"


def quote(text: str) -> str:
    """A Java regular expression for the literal text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if re.search(r"[^\w ]", text) else text


def term(col: Column, text: str) -> Column:
    """Substring, case-sensitive. The empty term matches every line."""
    return col.contains(text) if text else F.lit(True) & col.isNotNull()


def wildcard(col: Column, pattern: str) -> Column:
    """``A*B``: the parts in order. Leading and trailing ``*`` say nothing."""
    parts = [p for p in pattern.split("*") if p]
    if len(parts) <= 1:
        return term(col, parts[0] if parts else "")
    return col.rlike("(?s)" + ".*".join(map(quote, parts)))


def phrase(col: Column, tokens: list[str]) -> Column:
    """Tokens in order, with a run of delimiters between each two.

    The first token may begin inside a word of the line and the last may end inside one. Tokens
    that are delimiters stand for themselves within the run around them.
    """
    tokens = [t for t in tokens if t]
    if len(tokens) <= 1:
        return wildcard(col, tokens[0] if tokens else "")
    out, after_word = "", False
    for i, t in enumerate(tokens):
        if t in DELIMITERS:
            # Further delimiters may stand on both sides of one that is asked for.
            out += ("[ \\t:=,]*" if after_word or i else "") + quote(t) + ("[ \\t:=,]*" if i + 1 < len(tokens) else "")
            after_word = False
        else:
            out += (_DELIMITER_RUN if after_word else "") + ".*".join(quote(p) for p in t.split("*") if p)
            after_word = True
    return col.rlike("(?s)" + out)


def tokens_of(col: Column) -> Column:
    """A line's tokens; delimiters are tokens of their own."""
    return F.regexp_extract_all(col, F.lit("[^ \\t:=,]+|[ \\t:=,]"), F.lit(0))
