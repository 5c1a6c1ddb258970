"""Shard assignment through fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of virtual slots. Bytes and rows are aggregated per slot (one
small row per slot, whatever the input), and a map places slots on shards so that bytes come out
near equal. The map is a table with a version that names every slot, empty ones too; rebalancing
edits it (moves some slots) and writes the next version, so records never need to be hashed again.
Places within a shard come from the records at hand, not from the map.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Virtual slots. Fixed for the life of a corpus.
SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long"
#: Parts of a slot that are numbered apart, so that an id that a third of all rows bear is no single group.
PARTS = 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Slim rows (doc_id, size, text_crc32, virtual_slot) of documents.

    Size is the UTF-8 bytes of the text plus 8; null text counts none. Null ids hash by their
    text. Repeated rows are records of their own. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    key = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))
    return docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(recs: DataFrame) -> DataFrame:
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots dealt in turn, before any sizes are known: what version 1 is edited from."""
    return {slot: slot % shards for slot in range(slots)}


def edit_map(place: dict[int, int], totals: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Every slot's shard after rebalancing for another shard count or changed sizes (slot, bytes, rows).

    Slots of shards that are no longer there, and the smallest ones of shards over the mean, are
    freed; the freed ones go, largest first, to the shard with the fewest bytes. Others stay.
    """
    size = dict.fromkeys(range(slots), 0) | {t[0]: t[1] for t in totals}
    held: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot in size:
        shard = place.get(slot, shards)
        (held[shard] if shard < shards else homeless).append(slot)
    load = [sum(size[s] for s in own) for own in held]
    mean = sum(size.values()) / max(1, shards)
    place = {}
    for shard, own in enumerate(held):
        for slot in sorted(own, key=lambda k: (size[k], k)):
            if size[slot] and load[shard] - size[slot] >= mean:
                load[shard] -= size[slot]
                homeless.append(slot)
            else:
                place[slot] = shard
    heap = [(b, shard) for shard, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda k: (-size[k], k)):
        b, shard = heapq.heappop(heap)
        place[slot] = shard
        heapq.heappush(heap, (b + size[slot], shard))
    return place


def map_rows(place: dict[int, int], totals: list[tuple[int, int, int]], version: int) -> list[tuple]:
    """Rows of MAP_SCHEMA, one for each slot."""
    held = {t[0]: t[1:] for t in totals}
    return [(version, slot, place[slot], *held.get(slot, (0, 0))) for slot in sorted(place)]


def store_map(spark: SparkSession, rows: list[tuple], path: str) -> DataFrame:
    """Append one version to the map table at ``path`` (at most SLOTS rows a version)."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return load_map(spark, path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == F.lit(version))


def latest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """Version and slot -> shard of the last map at ``path``; 0 and no slots where there is none."""
    try:
        rows = load_map(spark, path).select("version", "virtual_slot", "shard").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return max((r[0] for r in rows), default=0), {r[1]: r[2] for r in rows}


def collect_totals(recs: DataFrame) -> list[tuple[int, int, int]]:
    """At most SLOTS rows, whatever the input."""
    return [(r[0], r[1], r[2]) for r in slot_totals(recs).collect()]


def assign(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with shard and slot, the record's place within its shard (gapless from 0).

    The map has at most SLOTS rows and the parts of slots at most SLOTS * PARTS, so both are
    broadcast. Records are numbered within a part, and a part starts where the ones before it in
    the shard end; nothing is sorted globally. A record whose slot is not in the map is an error.
    Records are read twice and must say the same each time: pass a written table.
    """
    part = F.col("part") if "part" in recs.columns else F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS))
    recs = recs.withColumn("part", part)
    counts = recs.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"))
    m = F.broadcast(slot_map.select("virtual_slot", "shard"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(m, "virtual_slot", "left").select("virtual_slot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    shard = F.when(F.col("shard").isNull(), F.raise_error(F.format_string("slot %d is not in the map", "virtual_slot"))).otherwise(F.col("shard"))
    w = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        recs.withColumn("place", F.row_number().over(w) - 1)
        .join(F.broadcast(starts), ["virtual_slot", "part"])
        .select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("first") + F.col("place")).cast("long").alias("slot"), "virtual_slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24, map_path: str | None = None) -> DataFrame:
    """Put documents into ``shards`` shards of near equal bytes (law ``bytes``); an empty table stays empty.

    A map found at ``map_path`` is edited, so that few slots move, and stored as its next version.
    Without one, version 1 deals the slots in turn and version 2 edits it by the bytes measured.
    """
    spark = docs.sparkSession
    # The writing task's number spreads the records of one id over the parts of their slot.
    recs = common.written(records(docs).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), "records")
    totals = collect_totals(recs)
    path = map_path or f"{common.shared_dir(spark)}/slot-map-{common.uuid.uuid4().hex}"
    if not map_path:
        common.atexit.register(common._remove, spark, path)
    version, place = latest(spark, path) if map_path else (0, {})
    if not version:
        version, place = 1, first_map(shards)
        store_map(spark, map_rows(place, totals, version), path)
    slot_map = store_map(spark, map_rows(edit_map(place, totals, shards), totals, version + 1), path)
    return assign(recs, slot_map).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
