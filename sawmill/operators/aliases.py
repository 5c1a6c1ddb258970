"""Field aliases: names for template variables, per index and per segment."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Var = tuple[int, int]
_EV = re.compile(r"^E(\d+)_V(\d+)(?:\.[A-Z]+)?$", re.I)
_PLAIN = re.compile(r"^(\d+)_(\d+)(?:\.\w+)?$")


def parse_var(text: str) -> Var | None:
    """``E7_V4``, ``7_4``, ``7_4.2``, ``E7_V4.VAR``, or the packed integer form."""
    text = text.strip()
    if m := _EV.match(text) or _PLAIN.match(text):
        return int(m[1]), int(m[2])
    if text.isdigit() and int(text) > 0xFFFF:
        return int(text) >> 16, (int(text) >> 8) & 0xFF
    return None


def format_var(var: Var) -> str:
    return f"E{var[0]}_V{var[1]}"


@dataclass
class Aliases:
    """Aliases of one scope. A variable belongs to one alias at a time."""

    of: dict[str, list[Var]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> "Aliases":
        """``alias: E7_V4, E6_V4`` lines; the older ``E7_V4=alias``; ``#`` begins a comment."""
        out = cls()
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            if "=" in line and (":" not in line or line.index("=") < line.index(":")):
                left, name = (x.strip() for x in line.split("=", 1))
                if (var := parse_var(left)) and name:
                    out.add(name, var)
            elif ":" in line:
                name, rest = (x.strip() for x in line.split(":", 1))
                for part in rest.split(","):
                    if var := parse_var(part):
                        out.add(name, var)
        return out

    def add(self, name: str, *variables: Var) -> None:
        """Map variables to an alias; one that another alias has moves, with a warning."""
        mine = self.of.setdefault(name, [])
        for var in variables:
            other = self.alias_of(var)
            if other == name:
                continue
            if other is not None:
                self.warnings.append(f"{format_var(var)} moves from {other} to {name}")
                self.of[other].remove(var)
                if not self.of[other]:
                    del self.of[other]
            mine.append(var)

    def get(self, name: str) -> list[Var]:
        """Variables of an alias, whatever its case."""
        return next((v for k, v in self.of.items() if k.lower() == name.lower()), [])

    def alias_of(self, var: Var) -> str | None:
        return next((k for k, v in self.of.items() if var in v), None)

    def dump(self) -> str:
        return "".join(f"{k}: {', '.join(map(format_var, sorted(v)))}\n" for k, v in sorted(self.of.items()))


def table(spark: SparkSession, scopes: dict[str, Aliases]) -> DataFrame:
    """The alias dimension: scope (``index:<name>`` or ``segment:<id>``), alias, template_id, var_idx."""
    rows = [(s, k, t, v) for s, a in scopes.items() for k, vs in a.of.items() for t, v in vs]
    return spark.createDataFrame(rows, "scope string, alias string, template_id int, var_idx int")


def resolve(scopes: dict[str, Aliases], index: str, segment: str | None = None) -> Aliases:
    """A segment's own aliases if it has any, else those of its index."""
    return scopes.get(f"segment:{segment}") or scopes.get(f"index:{index}") or Aliases()


def values(lines: DataFrame, alias_table: DataFrame) -> DataFrame:
    """Aliased values in long form (all line columns but vars, plus alias and value): a broadcast join by template."""
    from pyspark.sql import functions as F

    small = F.broadcast(alias_table.select("alias", "template_id", "var_idx"))
    return lines.join(small, "template_id").withColumn("value", F.get(F.col("vars"), F.col("var_idx"))).drop("vars", "var_idx").where("value is not null")
