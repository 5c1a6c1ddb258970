"""Alias discovery: guess what each template variable means from its values and from its neighbours.

A meaning is judged by the share of a variable's values that are of its form, and by the words
next to the variable. Forms are independent of each other: a value may be of several (``404`` is a
status and a port), and the narrower form wins where shares are equal.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aliases import Aliases
from .mining import Template, numbered, variables

#: Share of a variable's distinct values that must be of a form, meanings kept, tokens that are near.
SHARE, MOST, REACH = 0.5, 2, 3
#: Forms that any small number has: where shares are equal, a meaning that a word beside the variable names comes before them.
BARE = {"http_status", "port"}

METHODS = ["GET", "HEAD", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "TRACE", "CONNECT"]
TIMES = ["H:mm:ss", "H:mm", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd/MMM/yyyy"]

#: Words that name a meaning when they stand beside a variable.
NAMED = {
    "ip": {"ip", "addr", "address", "rhost", "src", "dst", "client", "peer", "remote"},
    "username": {"user", "username", "login", "logname", "account", "uid", "owner"},
    "hostname": {"host", "hostname", "server", "node", "machine"},
    "time": {"time", "timestamp", "date", "day", "hour"},
    "pid": {"pid", "ppid", "process"},
    "port": {"port", "sport", "dport"},
    "http_method": {"method", "verb"},
    "http_status": {"status", "code"},
    "path": {"path", "uri", "file", "dir"},
}


def _digits(v: Column, most: int) -> Column:
    return v.rlike(rf"^[0-9]{{1,{most}}}$")


def _within(v: Column, low: int, high: int) -> Column:
    return F.coalesce(v.try_cast("int").between(low, high), F.lit(False))


def _hex(v: Column, low: int, high: int) -> Column:
    return F.length(v).between(low, high) & (F.translate(F.lower(v), "0123456789abcdef", "") == "")


def forms(value: Column) -> dict[str, Column]:
    """Whether a value is of each form, narrow forms first."""
    v = F.trim(value)
    octets, groups, dashed, at = F.split(v, r"\."), F.split(v, ":"), F.split(v, "-"), F.split(v, "@")
    domain = F.split(F.get(at, 1), r"\.")
    labels = lambda parts: (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike("^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?$"))
    empty = F.size(F.filter(groups, lambda g: g == ""))
    number = v.try_cast("double").isNotNull()
    return {
        "uuid": (F.size(dashed) == 5) & (F.transform(dashed, F.length) == F.array(*map(F.lit, (8, 4, 4, 4, 12)))) & F.forall(dashed, lambda g: _hex(g, 4, 12)),
        "mac": F.exists(F.array(groups, dashed), lambda parts: (F.size(parts) == 6) & F.forall(parts, lambda g: _hex(g, 2, 2))),
        "ip": ((F.size(octets) == 4) & F.forall(octets, lambda o: _digits(o, 3) & _within(o, 0, 255)))
        | (F.size(groups).between(3, 8) & (empty.between(0, 2)) & (empty < F.size(groups)) & ((empty > 0) | (F.size(groups) == 8)) & F.forall(groups, lambda g: (g == "") | _hex(g, 1, 4))),
        "email": (F.size(at) == 2) & (F.get(at, 0) != "") & ~v.rlike(r"\s") & F.coalesce(labels(domain) & F.element_at(domain, -1).rlike("^[A-Za-z]{2,}$"), F.lit(False)),
        "url": F.coalesce(F.try_parse_url(v, F.lit("PROTOCOL")).isin("http", "https", "ftp") & F.try_parse_url(v, F.lit("HOST")).isNotNull(), F.lit(False)),
        "time": F.coalesce(*[F.try_to_timestamp(v, F.lit(t)) for t in TIMES]).isNotNull(),
        "http_method": v.isin(*METHODS),
        "http_status": _digits(v, 3) & _within(v, 100, 599),
        "hash": _hex(v, 16, 128),
        "path": v.contains("/") & ~v.contains("://") | v.rlike(r"^[A-Za-z]:\\"),
        "port": _digits(v, 5) & _within(v, 1, 65_535),
        "hostname": labels(octets) & F.element_at(octets, -1).rlike("[A-Za-z]"),
        "username": v.rlike("^[A-Za-z0-9_]{3,20}$") & ~number,
    }


def value_form(value: Column) -> Column:
    """The narrowest form of one value; null if it is of none."""
    return F.coalesce(*[F.when((F.trim(value) != "") & is_it, F.lit(name)) for name, is_it in forms(value).items()])


def form_shares(values: DataFrame) -> DataFrame:
    """(template_id, var_idx, and for each form the share of the variable's distinct values, all of them, that are of it)."""
    distinct = values.where("trim(value) <> ''").select("template_id", "var_idx", "value").distinct()
    return distinct.groupBy("template_id", "var_idx").agg(*[F.avg(c.cast("double")).alias(name) for name, c in forms(F.col("value")).items()])


def neighbours(template: Template) -> dict[int, dict[str, float]]:
    """For each variable the meanings that words beside it name: 1 for the word before it, less for others near."""
    out: dict[int, dict[str, float]] = defaultdict(dict)
    words = [(i, t) for i, t in enumerate(template.tokens) if t is None or t.strip(" \t:=,")]
    var = -1
    for place, (_, token) in enumerate(words):
        if token is not None:
            continue
        var += 1
        for step in range(1, REACH + 1):
            for at in (place - step, place + step):
                word = words[at][1] if 0 <= at < len(words) else None
                near = (word or "").strip("\"'()[]{}<>;.").lower()
                weight = 1.0 if at == place - 1 else 0.4 / step
                for kind, names in NAMED.items():
                    if near in names:
                        out[var][kind] = max(weight, out[var].get(kind, 0.0))
    return out


def suggest(matched: DataFrame, templates: list[Template]) -> dict[tuple[int, int], list[str]]:
    """Up to MOST meanings for each variable, best first: share of its values plus what its neighbours name.

    A form counts from SHARE on; a name without values of its form counts as far as it is near. Of
    equals, forms of bare numbers that no neighbour names come last. What comes to the driver is
    bounded by the templates' variables.
    """
    ids = numbered(templates)
    beside: dict[tuple[int, int], set[str]] = defaultdict(set)
    names = list(forms(F.lit("")))
    scores: dict[tuple[int, int], dict[str, float]] = defaultdict(dict)
    for r in form_shares(variables(matched)).collect():
        scores[r["template_id"], r["var_idx"]] = {n: r[n] for n in names if r[n] >= SHARE}
    for t in templates:
        for var, named in neighbours(t).items():
            for kind, weight in named.items():
                own = scores[ids[t], var]
                beside[ids[t], var].add(kind)
                own[kind] = own.get(kind, 0.0) + weight
    rank = {n: i for i, n in enumerate([*names, "pid"])}
    bare = {key: BARE - beside[key] for key in scores}
    return {key: [k for k, s in sorted(kinds.items(), key=lambda x: (-x[1], x[0] in bare[key], rank[x[0]])) if s >= SHARE][:MOST] for key, kinds in scores.items()}


def discover(matched: DataFrame, templates: list[Template]) -> Aliases:
    """Suggested aliases; each variable goes under its best meaning."""
    found = Aliases()
    for key, kinds in sorted(suggest(matched, templates).items()):
        if kinds:
            found.add(kinds[0], key)
    return found


def merge(several: list[Aliases]) -> Aliases:
    """Suggestions of several segments as one."""
    out = Aliases()
    for one in several:
        for name, held in one.of.items():
            out.add(name, *held)
    return out
