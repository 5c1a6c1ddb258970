"""Where a field's values come from: typed columns, or variables of mined templates through aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import QueryError


class ColumnFields:
    """Fields are columns of the lines (names in any case), or expressions given by name."""

    def __init__(self, columns: dict[str, Column] | list[str]):
        named = columns if isinstance(columns, dict) else {c: c for c in columns}
        self.columns = {k.lower(): v for k, v in named.items()}

    @property
    def names(self) -> set[str]:
        return set(self.columns)

    def attach(self, lines: DataFrame) -> DataFrame:
        return lines

    def values(self, name: str) -> list[Column]:
        """The columns that hold a field; null where a line does not have it."""
        if name.lower() not in self.columns:
            raise QueryError(f"unknown field: {name}")
        found = self.columns[name.lower()]
        return [F.col(found) if isinstance(found, str) else found]

    def value(self, name: str) -> Column:
        return F.coalesce(*self.values(name)) if len(self.values(name)) > 1 else self.values(name)[0]


class AliasFields:
    """Fields are aliases of template variables.

    ``aliases`` maps an alias to (template_id, var_idx) pairs. The map is a query-time
    configuration of bounded size, so it compiles into CASE expressions on the line itself: no join,
    no shuffle, and the template id stays a pushed-down predicate. Segments with aliases of their own
    (``segments``: segment to aliases) use those and not the index's.
    """

    def __init__(self, aliases: dict[str, list[tuple[int, int]]], constants: dict[int, str] | None = None, segments: dict[str, dict[str, list[tuple[int, int]]]] | None = None):
        self.aliases = {k.lower(): list(dict.fromkeys(v)) for k, v in aliases.items()}
        self.segments = {s: {k.lower(): list(dict.fromkeys(v)) for k, v in of.items()} for s, of in (segments or {}).items()}
        self.constants = constants or {}

    @property
    def names(self) -> set[str]:
        return set(self.aliases).union(*self.segments.values())

    def _scopes(self, name: str) -> list[tuple[Column | None, list[tuple[int, int]]]]:
        """(which segments, variables) of an alias."""
        low = name.lower()
        if low not in self.names:
            raise QueryError(f"unknown field: {name}")
        rest = ~F.col("segment_id").isin(sorted(self.segments)) if self.segments else None
        scopes = [(rest, self.aliases.get(low, []))] + [(F.col("segment_id") == s, of.get(low, [])) for s, of in sorted(self.segments.items())]
        return [(where, held) for where, held in scopes if held]

    def attach(self, lines: DataFrame) -> DataFrame:
        return lines

    def values(self, name: str) -> list[Column]:
        out = []
        for where, held in self._scopes(name):
            by_var: dict[int, list[int]] = {}
            for template, var in held:
                by_var.setdefault(var, []).append(template)
            for var, ids in sorted(by_var.items()):
                mine = F.col("template_id").isin(ids)
                out.append(F.when(mine if where is None else where & mine, F.get(F.col("vars"), F.lit(var))))
        return out

    def value(self, name: str) -> Column:
        """One value for each line: the first of its template's variables under the alias."""
        return F.coalesce(*self.values(name))

    def owns(self, name: str) -> Column:
        owned = [(where, F.col("template_id").isin(sorted({t for t, _ in held}))) for where, held in self._scopes(name)]
        return any_of([mine if where is None else where & mine for where, mine in owned])


def long_form(lines: DataFrame, fields: ColumnFields | AliasFields, name: str, *keep: Column) -> DataFrame:
    """One row for each value a line has under a field (several variables of a template may share an alias)."""
    found = fields.values(name)
    if len(found) == 1:
        return lines.select(*keep, found[0].cast("string").alias("value")).where("value is not null")
    every = F.filter(F.array(*[v.cast("string") for v in found]), lambda v: v.isNotNull())
    return lines.select(*keep, F.explode(every).alias("value"))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
