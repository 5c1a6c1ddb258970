"""One query text to one DataFrame."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search, stats, timechart
from ..operators.fields import AliasFields, ColumnFields
from ..sources.store import Catalog, StoreError
from . import ast
from .command import Command, parse_command
from .lexer import split_pipe


def plan(text: str) -> tuple[str, Command | None]:
    """Search and command. A command may also stand alone, without a pipe; an unknown one is searched for as text."""
    left, right = split_pipe(text)
    if right is not None:
        command = parse_command(right)
        return (left, command) if command else (text.replace("|", " "), None)
    command = parse_command(text)
    return ("", command) if command else (text, None)


def run(lines: DataFrame, command: Command, fields=None, exact_distinct: bool = False, ts_ms: str = "ts_ms") -> DataFrame:
    """A command over lines that the search has kept."""
    if command.kind == "timechart":
        if command.span_ms > 0:
            return timechart.by_span(lines, command.span_ms, fields, command.group, ts_ms)
        return timechart.by_bins(lines, command.bins, command.start, command.end, fields, command.group, ts_ms)
    if command.kind == "top":
        return stats.top(lines, fields, command.field, command.k)
    if command.group:
        return stats.grouped(lines, fields, command.func, command.field, command.group)
    if command.func == "count":
        return stats.count(lines)
    return stats.scalar(lines, fields, command.func, command.field, exact_distinct)


def query(lines: DataFrame, text: str, fields=None, limit: int | None = search.DEFAULT_LIMIT, exact_distinct: bool = False) -> DataFrame:
    """Search lines, or search and aggregate. In front of a pipe several words are one phrase; alone they are ANDed."""
    left, command = plan(text)
    if command is None:
        return search.search(lines, left, limit, fields)
    return run(search.matching(lines, left, fields, piped=True), command, fields, exact_distinct)


class Engine:
    """Queries over the indices of a catalog.

    With ``session_cache`` the last so many results stay with Spark, under the query and the
    segments that it saw; new segments make a query run again. ``counters`` holds how many queries
    were planned and answered from the cache, and the seconds that planning took.
    """

    def __init__(self, catalog: Catalog, session_cache: int = 0):
        self.catalog, self.session_cache = catalog, session_cache
        self.held: dict[tuple, DataFrame] = {}
        self.counters = {"queries": 0, "cached": 0, "plan_seconds": 0.0}

    def query(self, index: str, text: str, limit: int | None = search.DEFAULT_LIMIT, exact_distinct: bool = False) -> DataFrame:
        if not index or not text:
            raise StoreError("missing index or q")
        began = time.monotonic()
        self.counters["queries"] += 1
        if not self.session_cache:
            out = self._planned(index, text, limit, exact_distinct)
        else:
            seen = tuple(sorted(map(tuple, self.catalog.segments(index).select("segment_id", "written_ms").collect())))
            key = (index, text, limit, exact_distinct, seen)
            out = self.held.pop(key, None)
            self.counters["cached"] += out is not None
            out = self._planned(index, text, limit, exact_distinct).persist() if out is None else out
            self.held[key] = out
            while len(self.held) > self.session_cache:
                self.held.pop(next(iter(self.held))).unpersist()
        self.counters["plan_seconds"] += time.monotonic() - began
        return out

    def _planned(self, index: str, text: str, limit: int | None, exact_distinct: bool) -> DataFrame:
        lines = self.catalog.lines(index)
        aliases = self.catalog.aliases(index)
        scopes = {s: a.of for s, a in self.catalog.scopes(index).items()}
        templates = self.catalog.templates(index)
        fields = None
        if aliases.of or scopes:
            wanted = sorted({t for of in (aliases.of, *scopes.values()) for vs in of.values() for t, _ in vs})
            content = {r[0]: r[1] for r in templates.where(F.col("template_id").isin(wanted)).select("template_id", "content").distinct().collect()}
            fields = AliasFields(aliases.of, content, scopes)
        left, command = plan(text)
        if command is None:
            return search.records(search.search(lines, left, limit, fields), templates)
        return run(search.matching(lines, left, fields, piped=True), command, fields, exact_distinct)


def column_fields(lines: DataFrame) -> ColumnFields:
    return ColumnFields([c for c in lines.columns if c not in ("raw", "ts_ms", "line_no", "segment_id")])


def render(result: DataFrame, command: Command | None, pretty: bool = False) -> str:
    """A result as the JSON text of a response; doubles have six decimals."""
    rows = [r.asDict(recursive=True) for r in result.collect()]
    if command is not None and command.kind == "timechart" and command.group and rows and "points" not in rows[0]:
        nested: dict[str, list] = {}
        for r in rows:
            nested.setdefault(r["key"], []).append({"ts": r["ts"], "count": r["count"]})
        rows = [{"key": k, "points": v} for k, v in nested.items()]
    one = command is not None and command.kind == "stats" and not command.group
    value = rows[0] if one else rows
    return json.dumps(_six(value), indent=2 if pretty else None, separators=None if pretty else (",", ":"))


class _Six(float):
    def __repr__(self) -> str:
        return f"{float(self):.6f}"


def _six(x):
    if isinstance(x, float):
        return _Six(x)
    if isinstance(x, list):
        return [_six(v) for v in x]
    return {k: _six(v) for k, v in x.items()} if isinstance(x, dict) else x


__all__ = ["Engine", "ast", "column_fields", "plan", "query", "render", "run"]
