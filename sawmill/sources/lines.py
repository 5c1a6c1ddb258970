"""Lines in: raw text by Spark's readers, request bodies, typed tables as lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparse import line_ms


def is_line(value: Column) -> Column:
    """Not empty, and no bulk action (a ``{`` first and ``"index"`` in it)."""
    return (F.length(value) > 0) & ~(F.ltrim(value).startswith("{") & value.contains('"index"'))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, compressed ones too (gz, bz2, zst by their names): column ``raw``. Line ends of both kinds go."""
    if path.endswith(".zst"):
        return read_zstd(spark, path)
    return clean(spark.read.text(path).withColumnRenamed("value", "raw"))


def read_zstd(spark: SparkSession, path: str) -> DataFrame:
    """Lines of zstd files, which Hadoop reads with a native library only: one task a file, decompressed as a stream."""

    def lines(batches):
        import io

        import zstandard

        for pdf in batches:
            for content in pdf["content"]:
                found: list[str] = []
                reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True)
                for line in io.TextIOWrapper(reader, "utf-8", "replace", newline="\n"):
                    found.append(line.removesuffix("\n"))
                    if len(found) >= 10_000:
                        yield pd.DataFrame({"raw": found})
                        found = []
                yield pd.DataFrame({"raw": found}, dtype="str" if not found else None)

    return clean(spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "raw string"))


def stream_text(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return clean(reader.load(path).withColumnRenamed("value", "raw"))


def clean(lines: DataFrame) -> DataFrame:
    raw = F.when(F.col("raw").contains("\r"), F.regexp_replace("raw", "\r$", "")).otherwise(F.col("raw"))
    return lines.withColumn("raw", raw).where(is_line(F.col("raw")))


def from_bodies(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Request bodies (one row each) to lines, in order within a body."""
    keep = [c for c in bodies.columns if c != column]
    return clean(bodies.select(*keep, F.posexplode(F.split(F.col(column), "\n")).alias("pos", "raw")))


def with_time(lines: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Adds ts_ms (and ts) read from each line; lines without a time take the fallback, by default the time of ingest."""
    fallback = F.unix_millis(F.current_timestamp()) if fallback is None else fallback
    return lines.withColumn("ts_ms", line_ms(F.col("raw"), fallback)).withColumn("ts", F.timestamp_millis("ts_ms"))


def events_view(events: DataFrame) -> DataFrame:
    """The events table as log lines: its columns plus raw, ts_ms, line_no, segment_id."""
    ts = F.col("ts").cast("timestamp")
    raw = F.concat_ws(" ", F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss"), "event_type", F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit("props="), F.col("props")))
    return events.withColumn("raw", raw).withColumn("ts_ms", F.unix_millis(ts)).withColumn("line_no", F.col("event_id")).withColumn("segment_id", F.lit("events"))


def table_view(table: DataFrame, raw: str, line_no: str) -> DataFrame:
    """Any table with a text column as log lines."""
    return table.withColumn("raw", F.col(raw)).withColumn("line_no", F.col(line_no).cast("long")).withColumn("segment_id", F.lit("table"))
