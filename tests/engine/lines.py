"""A plain matcher of lines, written apart from the engine: the oracle for searches."""

import re

from sawmill.plans import ast

RUN = "[ \t:=,]+"


def phrase_regex(tokens):
    out, word = "", False
    for i, t in enumerate(tokens):
        if t in " \t:=,":
            out += (r"[ \t:=,]*" if word or i else "") + re.escape(t) + (r"[ \t:=,]*" if i + 1 < len(tokens) else "")
            word = False
        else:
            out += (RUN if word else "") + ".*".join(re.escape(p) for p in t.split("*") if p)
            word = True
    return re.compile(out, re.S)


def holds(tree, line):
    if isinstance(tree, ast.All):
        return True
    if isinstance(tree, ast.Phrase):
        if len(tree.tokens) == 1:
            at = 0
            for part in [p for p in tree.tokens[0].split("*") if p]:
                found = line.find(part, at)
                if found < 0:
                    return False
                at = found + len(part)
            return True
        return bool(phrase_regex(tree.tokens).search(line))
    if isinstance(tree, ast.Regex):
        return bool(re.search(tree.pattern, line))
    if isinstance(tree, ast.Not):
        return not holds(tree.of, line)
    if isinstance(tree, ast.And):
        return all(holds(p, line) for p in tree.parts)
    return any(holds(p, line) for p in tree.parts)
