"""Ingest as a stream: lines in micro-batches, each batch one segment; and a live timechart."""

from __future__ import annotations

import time
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import lines as source
from ..sources.store import Catalog, IndexConfig


def segment_of(stream: str, batch_id: int) -> str:
    return f"{stream}_{batch_id:012d}"


def start(catalog: Catalog, index: str, lines: DataFrame, checkpoint: str, stream: str = "ing", once: bool = False) -> StreamingQuery:
    """Write a stream of lines (column ``raw``) into an index.

    The trigger is the index's flush interval. A batch beyond the index's flush_records or
    flush_bytes becomes several segments; ``max_pending`` (see ``stream``) bounds what a batch takes.
    The checkpoint stands in for a write-ahead log: after a crash the unfinished batch runs again
    and, its segment being named by the batch, replaces what it had written. ``once`` flushes what
    is there and stops.
    """
    config = catalog.config(index)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.select("raw").persist()
        try:
            splits = held.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"), F.sum(F.octet_length("raw") + 1).alias("size")).orderBy("split").collect()
            records = sum(r["n"] for r in splits)
            parts = cuts(records, sum(r["size"] for r in splits), config)
            names = [segment_of(stream, batch_id) + (f"_{k}" if parts > 1 else "") for k in range(parts if records else 0)]
            if parts == 1:
                lines = held.withColumn("part", F.lit(0))
            else:
                # By the line's place in the batch, so that a batch that runs again is cut alike and no segment is beyond its share.
                before = [0] * (1 + splits[-1]["split"])
                for r, held_before in zip(splits, accumulate((r["n"] for r in splits), initial=0)):
                    before[r["split"]] = held_before
                place = F.get(F.lit(before), F.spark_partition_id()) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
                lines = held.withColumn("place", place.cast("long")).select("raw", F.expr(f"cast(place * {parts}L div {records}L as int)").alias("part"))
                # A segment is within the thresholds, so that a task may hold some. Their number is given: writing costs by the file, not by the byte.
                tasks = min(parts, int(catalog.spark.conf.get("spark.sql.shuffle.partitions")))
                lines = lines.repartition(tasks, "part")
            if names:
                catalog.write_segments(index, lines, names)
        finally:
            held.unpersist()
        if config.max_segments or config.max_disk_bytes:
            catalog.retain(index)

    writer = lines.writeStream.queryName(f"ingest-{index}-{stream}").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.flush_interval_ms} milliseconds")
    return writer.start()


def cuts(records: int, size: int, config: IndexConfig) -> int:
    """Segments that a batch becomes, so that each is within the index's thresholds (0: no threshold)."""
    by = [(records, config.flush_records), (size, config.flush_bytes)]
    return max(1, *[-(-n // most) for n, most in by if most > 0], 1)


def stream(catalog: Catalog, index: str, path: str) -> DataFrame:
    """Lines of new files of a directory, at most the index's ``max_pending`` files a batch."""
    return source.stream_text(catalog.spark, path, catalog.config(index).max_pending or None)


def bulk(catalog: Catalog, index: str, lines: DataFrame, segment: str | None = None) -> dict:
    """Write one bounded set of lines; large ones are cut into files of the index's flush_records."""
    config = catalog.config(index)
    meta = catalog.write_segment(index, source.clean(lines.select("raw")), segment or f"ing_{int(time.time() * 1000)}_0", file_records=config.flush_records)
    if config.max_segments or config.max_disk_bytes:
        catalog.retain(index)
    return {"ingested": meta["records"], "flushed": bool(meta["segment"]), "segment": meta["segment"]}


def live_timechart(lines: DataFrame, span: str, late: str, key: str | None = None) -> DataFrame:
    """Streaming counts by tumbling window (ts, [key,] count); lines later than ``late`` are left out.

    The watermark bounds the state. With a static frame it is the batch timechart.
    """
    timed = lines.withWatermark("ts", late) if lines.isStreaming else lines
    keys = [F.col(key).alias("key")] if key else []
    out = timed.groupBy(F.window("ts", span), *keys).agg(F.count("*").alias("count"))
    return out.select(F.unix_millis("window.start").alias("ts"), *(["key"] if key else []), "count")
