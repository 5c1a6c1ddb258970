"""Command line: ``python -m sawmill <root> <command> ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import search
from .operators.aliases import format_var, parse_var
from .plans import engine
from .plans.ast import QueryError
from .sources import lines as source
from .sources.store import Catalog, StoreError
from .streaming import ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sawmill")
    p.add_argument("root", help="directory of the catalog")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="search, or search | command")
    q.add_argument("index")
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=search.CLI_LIMIT)
    q.add_argument("--pretty", action="store_true")
    i = sub.add_parser("ingest", help="text files (compressed ones too) into an index")
    i.add_argument("index")
    i.add_argument("path")
    i.add_argument("--stream", metavar="CHECKPOINT", help="take new files of a directory as they come")
    c = sub.add_parser("create", help="create or update an index")
    c.add_argument("index")
    c.add_argument("options", nargs="*", metavar="name=value")
    for name in ("delete", "retain", "templates", "discover"):
        sub.add_parser(name).add_argument("index")
    sub.add_parser("indices")
    a = sub.add_parser("alias", help="list, get, find, add")
    a.add_argument("index")
    a.add_argument("action", choices=["list", "get", "find", "add"])
    a.add_argument("args", nargs="*")
    return p


def alias(catalog: Catalog, index: str, action: str, args: list[str]) -> str:
    held = catalog.aliases(index)
    if action == "list":
        return held.dump()
    if action == "get":
        return ", ".join(map(format_var, held.get(args[0]))) + "\n"
    if action == "find":
        return f"{held.alias_of(parse_var(args[0]) or (-1, -1)) or ''}\n"
    variables = [parse_var(x) for x in args[1:]]
    if None in variables or not variables:
        raise StoreError("a variable is written E<template>_V<number>")
    held.add(args[0], *variables)
    catalog.set_aliases(index, held)
    return "".join(w + "\n" for w in held.warnings) + held.dump()


def run(spark: SparkSession, argv: list[str]) -> str:
    args = parser().parse_args(argv)
    catalog = Catalog(spark, args.root)
    if args.command == "query":
        _, command = engine.plan(args.text)
        return engine.render(engine.Engine(catalog).query(args.index, args.text, args.limit), command, args.pretty) + "\n"
    if args.command == "ingest":
        if args.stream:
            ingest.start(catalog, args.index, ingest.stream(catalog, args.index, args.path), args.stream).awaitTermination()
            return ""
        return f"{ingest.bulk(catalog, args.index, source.read_text(spark, args.path))}\n"
    if args.command == "create":
        catalog.create(args.index, **dict(x.split("=", 1) for x in args.options))
        return ""
    if args.command == "delete":
        catalog.delete(args.index)
        return ""
    if args.command == "retain":
        return "".join(f"{s}\n" for s in catalog.retain(args.index))
    if args.command == "templates":
        return "".join(f"E{r.template_id} {r['count']} {r.content}\n" for r in catalog.templates(args.index).orderBy("segment_id", "template_id").toLocalIterator())
    if args.command == "discover":
        from .operators import discover, mining

        rows = catalog.templates(args.index).dropDuplicates(["template_id"]).collect()
        templates = [mining.Template(tuple(s.text if s.kind != "var" else None for s in r.segs)) for r in rows]
        found = discover.discover(catalog.lines(args.index), templates)
        catalog.set_aliases(args.index, found)
        return found.dump()
    if args.command == "alias":
        return alias(catalog, args.index, args.action, args.args)
    return "".join(f"{r['index']}\t{r.segments}\t{r.bytes}\n" for r in catalog.stats().collect())


def main() -> int:
    spark = SparkSession.builder.appName("sawmill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        sys.stdout.write(run(spark, sys.argv[1:]))
        return 0
    except (StoreError, QueryError) as e:
        sys.stderr.write(f"{e}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main())
