"""Counts over time: by span, by bins, and by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fields import long_form


def _keyed(found: DataFrame, fields, group: str | None, ts_ms: str) -> DataFrame:
    ms = F.col(ts_ms).cast("long").alias("ms")
    if group is None:
        return found.select(ms).where("ms is not null")
    return long_form(found, fields, group, ms).where("ms is not null and value <> ''").withColumnRenamed("value", "key")


def by_span(found: DataFrame, span_ms: int, fields=None, group: str | None = None, ts_ms: str = "ts_ms") -> DataFrame:
    """(ts, count), or (key, ts, count): buckets that hold lines, by time."""
    keys = ["key"] if group else []
    rows = _keyed(found, fields, group, ts_ms).withColumn("ts", F.col("ms") - F.pmod("ms", F.lit(span_ms)))
    return rows.groupBy(*keys, "ts").agg(F.count("*").alias("count")).orderBy(*keys, "ts")


def by_bins(found: DataFrame, bins: int = 60, start: int | None = None, end: int | None = None, fields=None, group: str | None = None, ts_ms: str = "ts_ms") -> DataFrame:
    """(ts, count), or (key, ts, count): every one of ``bins`` equal bins from start to end, empty ones too.

    Without a range, that of the lines is used, as a one-row aggregate joined by broadcast. A range
    that is no range gives no row.
    """
    spark = found.sparkSession
    rows = _keyed(found, fields, group, ts_ms)
    if start is not None and end is not None and end > start:
        span = spark.range(1).select(F.lit(start).cast("long").alias("lo"), F.lit(end).cast("long").alias("hi"))
        # Literal bounds reach the scan.
        rows = rows.where(F.col("ms").between(start, end))
    else:
        span = rows.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    span = F.broadcast(span.where("hi > lo").withColumn("width", F.greatest(F.lit(1).cast("long"), F.expr(f"(hi - lo) div {bins}"))))
    keys = ["key"] if group else []
    placed = rows.join(span, F.col("ms").between(F.col("lo"), F.col("hi"))).withColumn("bin", F.least(F.expr("(ms - lo) div width"), F.lit(bins - 1).cast("long")))
    counts = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    grid = spark.range(bins).withColumnRenamed("id", "bin").join(span).select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("ts"))
    if group:
        grid = counts.select("key").distinct().join(F.broadcast(grid))
    out = grid.join(counts, [*keys, "bin"], "left").select(*keys, "ts", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
    return out.orderBy(*keys, "ts")


def nested(flat: DataFrame) -> DataFrame:
    """(key, ts, count) -> (key, points): one row for each group, its points by time."""
    points = F.transform(F.sort_array(F.collect_list(F.struct("ts", "count"))), lambda p: p)
    return flat.groupBy("key").agg(points.alias("points")).orderBy("key")
