"""Aggregates: scalar, grouped, top, distinct, and the library's statistics. Results go by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import lenient
from ..plans.ast import QueryError
from .fields import long_form

#: 2**12 registers.
HLL_BITS = 12


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("count"))


def _numeric(func: str, value: Column) -> Column:
    n = lenient(value)
    return {
        "sum": F.coalesce(F.sum(n), F.lit(0.0)),
        "avg": F.coalesce(F.sum(n) / F.count("*"), F.lit(0.0)),
        "min": F.coalesce(F.min(n), F.lit(0.0)),
        "max": F.coalesce(F.max(n), F.lit(0.0)),
    }[func]


def scalar(found: DataFrame, fields, func: str, name: str, exact: bool = False) -> DataFrame:
    """One row (op, field, value). Averages count empty values as 0; without any value the result is 0."""
    rows = long_form(found, fields, name)
    if func == "distinct":
        rows = rows.where("value <> ''")
        value = F.countDistinct("value") if exact else F.coalesce(F.expr(f"hll_sketch_estimate(hll_sketch_agg(value, {HLL_BITS}))"), F.lit(0))
        value = value.cast("long")
    elif func in ("sum", "avg", "min", "max"):
        value = _numeric(func, F.col("value"))
    else:
        raise QueryError(f"unknown aggregate: {func}")
    return rows.agg(value.alias("value")).select(F.lit(func).alias("op"), F.lit(name).alias("field"), "value")


def sketch(found: DataFrame, fields, name: str, *by: str) -> DataFrame:
    """Mergeable distinct-count sketches of a field, one for each group: merge them with ``merged``."""
    rows = long_form(found, fields, name, *[F.col(b) for b in by]).where("value <> ''")
    return rows.groupBy(*by).agg(F.hll_sketch_agg("value", HLL_BITS).alias("sketch"))


def merged(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("long").alias("value"))


def _pairs(found: DataFrame, fields, value: str | None, group: str) -> DataFrame:
    """(key, value) of lines that have both; empty keys are dropped."""
    keys = fields.values(group)
    key = F.coalesce(*[k.cast("string") for k in keys])
    if value is None:
        return long_form(found, fields, group).withColumnRenamed("value", "key").where("key <> ''").withColumn("value", F.lit(None).cast("string"))
    return long_form(found, fields, value, key.alias("key")).where("key is not null and key <> ''")


def grouped(found: DataFrame, fields, func: str, value: str | None, group: str, exact: bool = True, ordered: bool = True) -> DataFrame:
    """(key, value) of a group field, by key. Distinct counts are exact and drop empty values."""
    rows = _pairs(found, fields, None if func == "count" else value, group)
    if func == "count":
        agg = F.count("*")
    elif func == "distinct":
        v = F.when(F.col("value") != "", F.col("value"))
        agg = F.countDistinct(v) if exact else F.approx_count_distinct(v, 0.01625)
    elif func in ("sum", "avg", "min", "max"):
        agg = _numeric(func, F.col("value"))
    else:
        raise QueryError(f"unknown aggregate: {func}")
    out = rows.groupBy("key").agg(agg.alias("value"))
    return out.orderBy("key") if ordered else out


def top(found: DataFrame, fields, name: str, k: int = 10) -> DataFrame:
    """The k most frequent values (value, count); ties go by value."""
    rows = long_form(found, fields, name).where("value <> ''")
    return rows.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)


def top_approximate(found: DataFrame, fields, name: str, k: int = 10) -> DataFrame:
    """The same from a bounded-size frequency sketch, for fields with very many values."""
    rows = long_form(found, fields, name).where("value <> ''")
    return rows.agg(F.expr(f"approx_top_k(value, {k})").alias("t")).select(F.explode("t").alias("t")).select(F.col("t.item").alias("value"), F.col("t.count").alias("count"))


# ------------------------------------------------------------------- library statistics


def frequencies(found: DataFrame, fields, name: str, k: int = 0) -> DataFrame:
    """Values with their counts; k <= 0: all of them."""
    rows = long_form(found, fields, name).where("value <> ''").groupBy("value").agg(F.count("*").alias("count"))
    rows = rows.orderBy(F.desc("count"), "value")
    return rows.limit(k) if k > 0 else rows


def average(found: DataFrame, fields, name: str) -> DataFrame:
    """Mean over non-empty values; 0 without any."""
    return long_form(found, fields, name).where("value <> ''").agg(F.coalesce(F.avg(lenient(F.col("value"))), F.lit(0.0)).alias("value"))


#: Values with their counts that come to the driver to be put in order.
ORDERED = 50_000


def _at_ranks(x: DataFrame, first: int, last: int, total: int, accuracy: int = 10_000) -> list[float]:
    """The values of ``x`` (column ``x``, no nulls) at two neighbouring ranks from 0 (or twice at one), exactly.

    A quantile sketch, merged from partial ones, brackets the ranks; the bracket is narrowed until its
    distinct values are at most ORDERED, which are counted and put in order. Each step reads the
    input once and leaves some 4 / accuracy of the rows, so two do for any size.
    """
    below, held, part = 0, total, x
    found: list[float] = []
    while True:
        if held > ORDERED:
            low_q, high_q = ((r - below) / max(1, held - 1) for r in (first, last))
            edges = [max(0.0, low_q - 2 / accuracy), min(1.0, high_q + 2 / accuracy)]
            low, high = part.agg(F.percentile_approx("x", F.array(*map(F.lit, edges)), F.lit(accuracy)).alias("e")).first()["e"]
            inner = part.where(F.col("x").between(low, high))
            n, under = part.agg(F.count_if(F.col("x").between(low, high)), F.count_if(F.col("x") < low)).first()
            if below + under <= first and last < below + under + n and (low == high or n < held):
                below, held, part = below + under, n, inner
                if low == high:
                    return [low, low]
                continue
        rows = part.groupBy("x").agg(F.count("*").alias("n")).orderBy("x").limit(ORDERED).collect()
        for r in rows:
            below += r["n"]
            held -= r["n"]
            found += [r["x"]] * ((below > first) + (below > last) - len(found))
            if len(found) == 2:
                return found
        part = part.where(F.col("x") > rows[-1]["x"])


def _values_at(found: DataFrame, fields, name: str, ranks) -> DataFrame:
    """The mean of the values at the two ``ranks(total)``, neighbours or the same; 0 without values."""
    x = long_form(found, fields, name).where("value <> ''").select(lenient(F.col("value")).alias("x"))
    total = x.count()
    got = _at_ranks(x, *ranks(total), total) if total else [0.0, 0.0]
    return found.sparkSession.createDataFrame([((got[0] + got[1]) / 2,)], "value double")


def median(found: DataFrame, fields, name: str) -> DataFrame:
    """The middle value, or the mean of the two in the middle."""
    return _values_at(found, fields, name, lambda n: ((n - 1) // 2, n // 2))


def stddev(found: DataFrame, fields, name: str) -> DataFrame:
    """Of the population."""
    return long_form(found, fields, name).where("value <> ''").agg(F.coalesce(F.stddev_pop(lenient(F.col("value"))), F.lit(0.0)).alias("value"))


def percentile(found: DataFrame, fields, name: str, p: float) -> DataFrame:
    """The value at floor rank ``p * (n - 1) / 100``, without interpolation; 0 without values."""
    return _values_at(found, fields, name, lambda n: [math.floor(p * (n - 1) / 100)] * 2)


def grouped_average(found: DataFrame, fields, value: str, group: str) -> DataFrame:
    """Mean over non-empty values of each group, by key."""
    return _pairs(found, fields, value, group).where("value <> ''").groupBy("key").agg(F.avg(lenient(F.col("value"))).alias("value")).orderBy("key")
