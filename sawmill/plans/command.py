"""The command behind the pipe."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.timeparse import literal_ms

AGGREGATES = ("count", "sum", "avg", "min", "max", "distinct")
DEFAULT_K, DEFAULT_BINS = 10, 60


@dataclass(frozen=True)
class Command:
    """kind: stats, top or timechart. func and field say what is computed, group by what."""

    kind: str
    func: str = "count"
    field: str | None = None
    group: str | None = None
    k: int = DEFAULT_K
    span_ms: int = 0
    bins: int = DEFAULT_BINS
    start: int | None = None
    end: int | None = None


_STATS = re.compile(r"^stats\s+(?:(?P<f>sum|avg|min|max|distinct)\s*\(\s*(?P<v>[^)]*?)\s*\)|count(?:\s*\(\s*\))?)(?:\s+by\s+(?P<g>\S+))?$", re.I)
_TOP = re.compile(r"^top\s+(?P<k>\S+)\s+(?P<f>\S+)$", re.I)
_TOP_CALL = re.compile(r"^top\s*\(\s*(?P<f>[^,)]+?)\s*(?:,\s*(?P<k>[^)]*?)\s*)?\)$", re.I)
_DISTINCT = re.compile(r"^distinct\s*\(\s*(?P<f>[^)]+?)\s*\)$", re.I)
_BY = re.compile(r"^by\s*\(\s*(?P<g>[^)]+?)\s*\)\s*(?P<f>count|sum|avg|min|max|distinct)\s*\(\s*(?P<v>[^)]*?)\s*\)$", re.I)
_UNITS = {"": 1, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str) -> int:
    """``5``, ``5ms``, ``5s``, ``5m``, ``5h``, ``5d``; 0 if it is none of them."""
    m = re.fullmatch(r"(\d+)\s*(ms|s|m|h|d)?", text.strip().lower())
    return int(m[1]) * _UNITS[m[2] or ""] if m else 0


def size_bytes(text: str) -> int:
    """``64m``, ``1g``, ``2t``, ``10k`` or bytes; 0 if it is none of them."""
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", text.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 0


def _count(text: str | None) -> int:
    m = re.match(r"\d+", (text or "").strip())
    return int(m[0]) if m and int(m[0]) > 0 else DEFAULT_K


def parse_command(text: str) -> Command | None:
    """The command, or None if the text is none. ``+`` counts as a space."""
    r = text.replace("+", " ").strip()
    low = r.lower()
    if low.startswith("timechart"):
        return _timechart(r[len("timechart") :])
    if m := _STATS.match(r):
        return Command("stats", (m["f"] or "count").lower(), m["v"] or None, m["g"])
    if m := _TOP_CALL.match(r):
        return Command("top", field=m["f"].strip(), k=_count(m["k"]))
    if m := _TOP.match(r):
        return Command("top", field=m["f"], k=_count(m["k"]))
    if m := _DISTINCT.match(r):
        return Command("stats", "distinct", m["f"])
    if m := _BY.match(r):
        return Command("stats", m["f"].lower(), m["v"] or None, m["g"])
    return None


def _timechart(options: str) -> Command:
    def value(name: str) -> str:
        m = re.search(rf"(?:^|[\s&]){name}\s*=\s*(\"[^\"]*\"|[^\s&]+)", options, re.I)
        return m[1].strip('"') if m else ""

    group = re.search(r"(?:^|\s)by\s+([^\s&(]+)", options, re.I) or re.search(r"(?:^|\s)by\s*\(\s*([^)]+?)\s*\)", options, re.I)
    bins = re.match(r"\d+", value("bins"))
    start, end = (literal_ms(value(x)) if value(x) else None for x in ("start", "end"))
    return Command("timechart", group=group[1] if group else None, span_ms=duration_ms(value("span")), bins=int(bins[0]) if bins and int(bins[0]) else DEFAULT_BINS, start=start, end=end)
