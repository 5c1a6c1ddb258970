"""Hashes that identify templates and guard segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 32 bits: fixed values.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


def template_id(content: str) -> int:
    """A template's id: FNV-1a of its text, the low 16 bits, never 0."""
    h = FNV_OFFSET
    for byte in content.encode("utf-8"):
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFF
    return (h & 0xFFFF) or 1


def line_crc(line: Column) -> Column:
    """CRC-32 of a line with its line end."""
    return F.crc32(F.concat(line, F.lit("\n")))
