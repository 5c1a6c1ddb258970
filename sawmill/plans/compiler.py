"""Search tree to one Catalyst predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from .ast import All, And, FieldCompare, FieldMatch, Node, Not, Or, Phrase, QueryError, Regex, TimeRange


def predicate(tree: Node, fields=None, raw: str = "raw", ts_ms: str = "ts_ms") -> Column:
    """The tree as a boolean column over lines."""
    line = F.coalesce(F.col(raw), F.lit(""))

    def build(node: Node) -> Column:
        if isinstance(node, All):
            return F.lit(True)
        if isinstance(node, Phrase):
            return text.wildcard(line, node.tokens[0]) if len(node.tokens) == 1 else text.phrase(line, list(node.tokens))
        if isinstance(node, Regex):
            return line.rlike(node.pattern)
        if isinstance(node, TimeRange):
            # A bare comparison, so that it reaches the Parquet scan's row-group statistics.
            # The parser keeps it a conjunct of its own, where a null time drops the line.
            return F.col(ts_ms).between(node.start, node.end)
        if isinstance(node, FieldMatch):
            return field_match(node, fields, line)
        if isinstance(node, FieldCompare):
            if fields is None:
                raise QueryError(f"unknown field: {node.name}")
            test = (lambda v: numeric.between(v, node.low, node.high)) if node.op == ".." else (lambda v: numeric.compare(v, node.op, node.low))
            return reduce(lambda a, b: a | b, [v.isNotNull() & test(v) for v in fields.values(node.name)])
        if isinstance(node, Not):
            return ~build(node.of)
        if isinstance(node, (And, Or)):
            return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), map(build, node.parts))
        raise QueryError(f"no such node: {node}")

    return build(tree)


def variable_hit(node: FieldMatch, fields) -> Column:
    if fields is None:
        raise QueryError(f"unknown field: {node.name}")
    hits = [F.coalesce(v.cast("string").contains(node.value), F.lit(False)) for v in fields.values(node.name)]
    return reduce(lambda a, b: a | b, hits)


def field_match(node: FieldMatch, fields, line: Column) -> Column:
    """The value within one of the alias's variables; ``fallback`` marks lines for which the wider search counts."""
    hit = variable_hit(node, fields)
    if node.strict or not hasattr(fields, "aliases"):
        return hit
    return hit | F.coalesce(F.col(_fallback_name(node)), F.lit(False))


def _fallback_name(node: FieldMatch) -> str:
    return f"_fallback_{node.name}_{node.value}_{int(node.ci)}".replace(".", "_").replace("`", "_")


def field_nodes(tree: Node) -> list[FieldMatch]:
    if isinstance(tree, FieldMatch):
        return [tree]
    if isinstance(tree, Not):
        return field_nodes(tree.of)
    if isinstance(tree, (And, Or)):
        return [x for p in tree.parts for x in field_nodes(p)]
    return []


def with_fallbacks(lines: DataFrame, tree: Node, fields) -> DataFrame:
    """Columns for alias filters that may fall back to template constants.

    Where no variable of the alias holds the value in a (segment, template), the template's
    constants decide; where the alias has no hit at all, any line that holds the value counts.
    Whether there is a hit is one question to the input, which ends at the first. Only templates of
    the alias whose constants hold the value are then counted and joined; mostly there are none.
    """
    if not hasattr(fields, "aliases"):
        return lines
    for node in dict.fromkeys(n for n in field_nodes(tree) if not n.strict):
        hit = variable_hit(node, fields)
        name = _fallback_name(node)
        line = F.coalesce(F.col("raw"), F.lit(""))
        value = node.value.lower() if node.ci else node.value
        if lines.where(hit).limit(1).isEmpty():
            lines = lines.withColumn(name, F.lower(line).contains(value) if node.ci else line.contains(value))
            continue
        constants = sorted(t for t, c in fields.constants.items() if value in (c.lower() if node.ci else c))
        if not constants:
            lines = lines.withColumn(name, F.lit(False))
            continue
        keys = [c for c in ("segment_id", "template_id") if c in lines.columns]
        mine = fields.owns(node.name) & F.col("template_id").isin(constants)
        held = lines.where(mine & hit).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_any", F.lit(True))
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        lines = lines.join(held, match, "left").withColumn(name, mine & F.col("_any").isNull()).drop("_any", *[f"_{k}" for k in keys])
    return lines
