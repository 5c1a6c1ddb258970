"""Message templates: cluster, match, and put lines back together.

Lines are cut at delimiters, clustered by token count, all of them, and matched to the resulting
templates. A template is a list of constants, delimiters and variables; its id is a hash of its
text. Lines that match none are outliers (template -1) and keep their text like all others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import template_id
from ..functions.text import DELIMITERS, wildcard

SIMILARITY = 0.5
#: Templates of one token count that one task clusters. More are dealt into chunks, and the chunks' templates clustered again.
PER_LENGTH = 20_000
#: Templates are clustered again as long as a round leaves at most this share of them.
SHRINKS = 0.9
#: Growing templates that a task holds for one token count, and in all, while lines stream through it; beyond, they go on to the next round.
HELD, HELD_IN_ALL = 500, 20_000
#: Templates of all parts that the driver clusters itself.
HERE = 2_000
_TOKEN = re.compile(r"[^ \t:=,]+|[ \t:=,]")
_DELIMITERS = frozenset(DELIMITERS)


@dataclass(frozen=True)
class Template:
    """tokens: constants and delimiters, None for a variable."""

    tokens: tuple[str | None, ...]

    @property
    def content(self) -> str:
        n = iter(range(len(self.tokens)))
        return "".join(f"<V{next(n)}>" if t is None else t for t in self.tokens)

    @property
    def id(self) -> int:
        """Its id where no other template has the same hash; see ``numbered``."""
        return template_id(self.content)


def numbered(templates: list[Template]) -> dict[Template, int]:
    """Every template's id within its segment: its hash, or the next free number after it; beyond 16 bits once those are used up.

    The order of the texts decides who comes first, so the same templates have the same ids.
    """
    taken: set[int] = set()
    out = {}
    for t in sorted(set(templates), key=lambda t: (t.content, len(t.tokens), [x or "" for x in t.tokens])):
        at = t.id
        if len(taken) >= 0xFFFF:
            at = len(taken) + 1
        while at in taken:
            at = at % 0xFFFF + 1
        taken.add(at)
        out[t] = at
    return out


def split(line: str) -> list[str]:
    return _TOKEN.findall(line)


def _take(places: list[int]) -> Callable[[list], tuple]:
    """The items at these places, as a tuple whatever their number."""
    if not places:
        return lambda x: ()
    return itemgetter(*places) if len(places) > 1 else lambda x, at=places[0]: (x[at],)


class Fit:
    """Whether tokens, as many as the template's, agree with all its constants; and its variables' values."""

    def __init__(self, tokens: list[str | None] | tuple[str | None, ...]):
        self.fixed = _take([i for i, t in enumerate(tokens) if t is not None])
        self.values = _take([i for i, t in enumerate(tokens) if t is None])
        self.constants = self.fixed(tokens)

    def __call__(self, tokens: list[str]) -> tuple[str, ...] | None:
        if self.fixed(tokens) != self.constants:
            return None
        values = self.values(tokens)
        return values if _DELIMITERS.isdisjoint(values) else None


class Cluster:
    """One growing template: positions that ever differed are variables."""

    def __init__(self, tokens: list[str | None]):
        self.tokens: list[str | None] = list(tokens)
        self.fit = Fit(self.tokens)

    def similarity(self, tokens: list[str | None]) -> float:
        """Share of positions that agree; 0 if a delimiter stands where another token or a variable does."""
        same = 0
        for mine, t in zip(self.tokens, tokens):
            if ((t is not None and t in DELIMITERS) or (mine is not None and mine in DELIMITERS)) and mine != t:
                return 0.0
            same += mine is None or mine == t
        return same / max(1, len(tokens))

    def merge(self, tokens: list[str | None]) -> None:
        merged = [m if m == t else None for m, t in zip(self.tokens, tokens)]
        if merged != self.tokens:
            self.tokens, self.fit = merged, Fit(merged)


def join(found: list[Cluster], tokens: list[str | None], threshold: float = SIMILARITY) -> bool:
    """Greedy: tokens join the first template of their length that agrees on more than ``threshold``, or (False) begin one."""
    for c in found:
        if c.similarity(tokens) > threshold:
            c.merge(tokens)
            return True
    found.append(Cluster(tokens))
    return False


def cluster(templates: list[tuple[str | None, ...]], threshold: float = SIMILARITY) -> list[tuple[str | None, ...]]:
    """Templates of one length, those with most variables first: they take in the others."""
    found: list[Cluster] = []
    for tokens in sorted(map(list, templates), key=lambda t: (-sum(x is None for x in t), [x or "" for x in t])):
        join(found, tokens, threshold)
    return [tuple(c.tokens) for c in found]


def gathered(lines: DataFrame, threshold: float = SIMILARITY, held: int = HELD, in_all: int = HELD_IN_ALL) -> DataFrame:
    """What each task makes of all its lines (columns ``part``, ``raw``), part by part: ``part``, ``n``, ``tokens``.

    A line that fits a template of its part changes nothing; others join one or begin one. A task
    holds a bounded number of templates: the older ones are handed on, so every line fits a row.
    """

    def run(batches):
        found: dict[tuple[int, int], list[Cluster]] = {}
        number = 0
        full: list[tuple[int, int, list]] = []

        def out():
            parts, ns, tokens = zip(*full) if full else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(ns, pa.int32()), pa.array(tokens, pa.list_(pa.string()))], ["part", "n", "tokens"])

        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = split(raw)
                key = part, len(tokens)
                mine = found.get(key)
                if mine is None:
                    mine = found[key] = []
                elif any(c.fit(tokens) is not None for c in mine):
                    continue
                if join(mine, tokens, threshold):
                    continue
                number += 1
                for k in list(found) if number >= in_all else [key] if len(mine) >= held else []:
                    gone = found.pop(k)
                    number -= len(gone)
                    full += [(*k, c.tokens) for c in gone]
                if len(full) >= 10_000:
                    yield out()
                    full.clear()
        full += [(*k, c.tokens) for k, mine in found.items() for c in mine]
        yield out()

    return lines.where("raw is not null and raw <> ''").select(F.col("part").cast("int"), "raw").mapInArrow(run, "part int, n int, tokens array<string>")


def clustered(rows: DataFrame, threshold: float = SIMILARITY, per_length: int = PER_LENGTH) -> list[tuple[int, tuple[str | None, ...]]]:
    """Templates of all rows (columns ``part``, ``n``, ``tokens``) with their part; parts and token counts apart from each other.

    Few rows are clustered by the driver. Else a token count of a part with more than ``per_length``
    rows is dealt by hash into chunks of about that size; the chunks' templates are clustered again,
    until one chunk holds them or they no longer grow fewer. Every row fits one of the templates.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tokens": [list(t) for t in cluster(list(pdf["tokens"]), threshold)]}).assign(part=pdf["part"].iloc[0], n=pdf["n"].iloc[0])

    schema = "tokens array<string>, part int, n int"
    out: list[tuple[int, tuple[str | None, ...]]] = []
    held, before, salt = rows.persist(), {}, 0

    def of(keys) -> DataFrame:
        wanted = held.sparkSession.createDataFrame(list(keys), "part int, n int")
        return held.join(F.broadcast(wanted), ["part", "n"], "left_semi")

    def take(df: DataFrame) -> None:
        out.extend((r["part"], tuple(r["tokens"])) for r in df.select("part", "tokens").collect())

    while sizes := {(r[0], r[1]): r[2] for r in held.groupBy("part", "n").count().collect()}:
        if sum(sizes.values()) <= min(HERE, per_length):
            groups: dict[tuple[int, int], set] = {}
            for r in held.collect():
                groups.setdefault((r["part"], r["n"]), set()).add(tuple(r["tokens"]))
            out += [(part, t) for (part, _), mine in groups.items() for t in cluster(list(mine), threshold)]
            break
        stuck = {k for k, size in sizes.items() if size > per_length and size > SHRINKS * before.get(k, float("inf"))}
        small = {k for k, size in sizes.items() if size <= per_length}
        if stuck:
            take(of(stuck))
        if small:
            take(of(small).groupBy("part", "n").applyInPandas(run, schema))
        before = {k: size for k, size in sizes.items() if k not in stuck and k not in small}
        if not before:
            break
        chunks = F.broadcast(held.sparkSession.createDataFrame([(*k, -(-size // per_length)) for k, size in before.items()], "part int, n int, chunks int"))
        dealt = held.join(chunks, ["part", "n"]).withColumn("chunk", F.pmod(F.xxhash64("tokens", F.lit(salt)), F.col("chunks")))
        after = dealt.groupBy("part", "n", "chunk").applyInPandas(run, schema).distinct().persist()
        after.count()
        held.unpersist()
        held, salt = after, salt + 1
    held.unpersist()
    return out


def mine_parts(lines: DataFrame, threshold: float = SIMILARITY, per_length: int = PER_LENGTH) -> dict[int, list[Template]]:
    """Templates of all lines (columns ``part``, a small number, and ``raw``), each part's apart. Parts without text are left out.

    Tasks cluster their lines as they read them, then the tasks' templates are clustered. Templates
    are as many as the log has statements, so they come to the driver.
    """
    found: dict[int, set[Template]] = {}
    for part, tokens in clustered(gathered(lines, threshold, min(HELD, per_length)), threshold, per_length):
        found.setdefault(part, set()).add(Template(tokens))
    return {part: sorted(ts, key=lambda t: (len(t.tokens), sum(x is None for x in t.tokens), t.content)) for part, ts in found.items()}


def mine(lines: DataFrame, fraction: float = 1.0, seed: int = 11, threshold: float = SIMILARITY, per_length: int = PER_LENGTH) -> list[Template]:
    """Templates of all lines (column ``raw``). A caller who asks for a ``fraction`` gets those of a seeded sample."""
    if fraction < 1:
        lines = lines.where(F.pmod(F.xxhash64("raw", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))
    return mine_parts(lines.select(F.lit(0).alias("part"), "raw"), threshold, per_length).get(0, [])


class Matcher:
    """Templates by length and first constant, so that few are tried; those that begin with the line's token before those with a variable."""

    def __init__(self, templates: list[Template]):
        self.near: dict[tuple[int, str | None], list[tuple[int, Fit]]] = {}
        ids = numbered(templates)
        for t in templates:
            if t.tokens:
                self.near.setdefault((len(t.tokens), t.tokens[0]), []).append((ids[t], Fit(t.tokens)))

    def __call__(self, line: str | None) -> tuple[int, tuple[str, ...]]:
        """The id of the first template whose constants agree (-1: none does), and the variables' values."""
        tokens = split(line) if line else ()
        if tokens:
            for first in (tokens[0], None):
                for i, fit in self.near.get((len(tokens), first), ()):
                    values = fit(tokens)
                    if values is not None:
                        return i, values
        return -1, ()


def match(lines: DataFrame, templates: list[Template] | dict[int, list[Template]]) -> DataFrame:
    """All columns plus template_id (-1: outlier) and vars (array of strings). Templates of parts (column ``part``) are for the part's lines."""
    lines = lines.drop("template_id", "vars")
    shared = lines.sparkSession.sparkContext.broadcast(templates)
    by_part = isinstance(templates, dict)

    def run(batches):
        matchers: dict[int, Matcher] = {}
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            ids, ends, flat = [], [0], []
            for part, raw in zip(batch.column("part").to_pylist() if by_part else [0] * len(raws), raws):
                matcher = matchers.get(part)
                if matcher is None:
                    matcher = matchers[part] = Matcher(shared.value.get(part, []) if by_part else shared.value)
                i, values = matcher(raw)
                ids.append(i)
                flat.extend(values)
                ends.append(len(flat))
            more = [pa.array(ids, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "template_id", "vars"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields]
    return lines.mapInArrow(run, ", ".join([*names, "template_id int", "vars array<string>"]))


def segments(template: Template) -> list[dict]:
    """A template as segments: kind (const, delim, var), text, var."""
    out, var = [], 0
    for t in template.tokens:
        out.append({"kind": "var" if t is None else "delim" if t in DELIMITERS else "const", "text": t, "var": var if t is None else None})
        var += t is None
    return out


def texts(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """Every template: template_id, content, segs."""
    rows = [(i, t.content, segments(t)) for t, i in numbered(templates).items()]
    return spark.createDataFrame(rows, "template_id int, content string, segs array<struct<kind:string,text:string,var:int>>")


def catalog(matched: DataFrame, templates: list[Template]) -> DataFrame:
    """The template dimension: (segment_id,) template_id, count, content, segs; most frequent first."""
    keys = [c for c in ("segment_id",) if c in matched.columns]
    counts = matched.where("template_id <> -1").groupBy(*keys, "template_id").agg(F.count("*").alias("count"))
    return counts.join(F.broadcast(texts(matched.sparkSession, templates)), "template_id").select(*keys, "template_id", "count", "content", "segs").orderBy(*keys, F.desc("count"), "template_id")


def rebuild(matched: DataFrame, catalog_: DataFrame) -> DataFrame:
    """Lines put together again from constants and variables: adds ``rebuilt`` (outliers: the line itself).

    The catalog (or the templates' ``texts``) goes to all tasks: by its key, the lines of the most
    frequent template would be one task's.
    """
    keys = [c for c in ("segment_id",) if c in matched.columns and c in catalog_.columns]
    joined = matched.join(F.broadcast(catalog_.select(*keys, "template_id", "segs")), [*keys, "template_id"], "left")
    parts = F.transform("segs", lambda s: F.when(s["kind"] == "var", F.get(F.col("vars"), s["var"])).otherwise(s["text"]))
    return joined.withColumn("rebuilt", F.when(F.col("template_id") == -1, F.col("raw")).otherwise(F.array_join(parts, ""))).drop("segs")


def dump(catalog_: DataFrame) -> DataFrame:
    """Text lines ``E<id> <count> <content>``."""
    return catalog_.select(F.format_string("E%d %d %s", "template_id", "count", "content").alias("value"))


def variables(matched: DataFrame) -> DataFrame:
    """One row for each variable value: (segment_id,) template_id, var_idx, value."""
    keys = [c for c in ("segment_id",) if c in matched.columns]
    return matched.where("template_id <> -1").select(*keys, "template_id", F.posexplode("vars").alias("var_idx", "value"))


def select_values(matched: DataFrame, template: int, var: int, pattern: str | None = None, segment: str | None = None) -> DataFrame:
    """One variable's column (segment_id, line_no, value), of lines whose value holds ``pattern`` (``*`` stands for any run)."""
    rows = matched.where(F.col("template_id") == template)
    if segment is not None:
        rows = rows.where(F.col("segment_id") == segment)
    out = rows.select("segment_id", "line_no", F.get("vars", F.lit(var)).alias("value")).where("value is not null")
    return out if not pattern else out.where(wildcard(F.col("value"), pattern))


#: Bits of the character classes of a value.
CLASSES = {"0-9": 1, "A-F": 2, "a-f": 4, "G-Z": 8, "g-z": 16}
SYMBOL = 32


def profile(matched: DataFrame) -> DataFrame:
    """Each variable's column: rows, distinct values, longest value, character classes, and how it would be encoded."""
    v = F.col("value")
    bits = sum(((F.when(v.rlike(f"[{k}]"), b).otherwise(0)) for k, b in CLASSES.items()), F.lit(0)) + F.when(v.rlike("[^0-9A-Za-z]"), SYMBOL).otherwise(0)
    keys = [c for c in ("segment_id",) if c in matched.columns]
    out = variables(matched).groupBy(*keys, "template_id", "var_idx").agg(
        F.count("*").alias("rows"), F.approx_count_distinct("value").alias("distinct_values"), F.max(F.length("value")).alias("max_length"), F.bit_or(bits.cast("int")).alias("classes")
    )
    ratio = F.col("distinct_values") / F.col("rows")
    return out.withColumn("encoding", F.when(F.col("rows") < 100, "plain").when(ratio < 0.5, "dictionary").otherwise("pattern"))
