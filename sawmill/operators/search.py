"""Search: filter, order, limit, and the records that come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ast, compiler

DEFAULT_LIMIT, CLI_LIMIT = 100, 200


def matching(lines: DataFrame, query: str | ast.Node, fields=None, piped: bool = False) -> DataFrame:
    """Lines that match a query. Lines need ``raw``; ``ts_ms``, ``template_id`` and ``vars`` as far as the query uses them."""
    tree = query if isinstance(query, ast.Node) else ast.parse(query, fields.names if fields else None, piped)
    held = lines.columns
    if fields is not None:
        lines = compiler.with_fallbacks(fields.attach(lines), tree, fields)
    return lines.where(compiler.predicate(tree, fields)).select(*held)


def search(lines: DataFrame, query: str, limit: int | None = DEFAULT_LIMIT, fields=None) -> DataFrame:
    """The first ``limit`` matches by segment and line (None: all of them)."""
    found = matching(lines, query, fields)
    order = [c for c in ("segment_id", "line_no") if c in found.columns]
    found = found.orderBy(*order) if order else found
    return found if limit is None else found.limit(limit)


def records(found: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Output records: log_line, template_id, template, line_number. Lines of no template say OUTLIER.

    Templates are a dimension (one row for each template of a segment); Spark broadcasts it by size.
    """
    out = found
    if "template_id" not in out.columns:
        out = out.withColumn("template_id", F.lit(-1))
    if templates is not None and "segment_id" in out.columns:
        out = out.join(templates.select("segment_id", "template_id", F.col("content").alias("template")), ["segment_id", "template_id"], "left")
    else:
        out = out.withColumn("template", F.lit(None).cast("string"))
    number = F.col("line_no").cast("long") if "line_no" in out.columns else F.lit(None).cast("long")
    return out.select(
        F.col("raw").alias("log_line"),
        "template_id",
        F.when(F.col("template_id") == -1, F.lit("OUTLIER")).otherwise(F.col("template")).alias("template"),
        number.alias("line_number"),
    )
