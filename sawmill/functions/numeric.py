"""Numbers in log text: a lenient and a strict reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def lenient(col: Column) -> Column:
    """The longest numeric prefix as a double, 0 without one: ``12abc`` is 12, ``abc`` is 0."""
    return F.coalesce(F.trim(F.regexp_extract(col.cast("string"), _PREFIX, 0)).try_cast("double"), F.lit(0.0))


def strict(col: Column) -> Column:
    """A whole integer, up to white space; an empty value is 0, anything else null."""
    text = col.cast("string")
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.regexp_extract(text, r"^\s*([+-]?\d+)(?:\s|$)", 1).try_cast("bigint"))


def compare(col: Column, op: str, value: int) -> Column:
    v = strict(col)
    return F.coalesce({"==": v == value, "!=": v != value, ">": v > value, ">=": v >= value, "<": v < value, "<=": v <= value}[op], F.lit(False))


def between(col: Column, low: int, high: int) -> Column:
    return F.coalesce(strict(col).between(low, high), F.lit(False))
