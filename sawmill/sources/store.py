"""The store: a catalog of indices, immutable segments as Parquet partitions, retention.

An index is a directory. ``lines/segment_id=<id>/dt=<day>`` holds its lines, ``templates`` and
``segments`` its dimensions, one folder for each segment too. A segment becomes visible with its
row in ``segments``, which is written last and taken away first, so a batch that is run again after
a failure, on another day too, replaces all that it had written and is counted once.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import time
import uuid
from dataclasses import asdict, dataclass, fields
from functools import reduce
from operator import xor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import line_crc
from ..operators import mining
from ..operators.aliases import Aliases
from ..plans.command import size_bytes
from . import lines as source

LINES = "raw string, line_no long, ts_ms long, ts timestamp, template_id int, vars array<string>, segment_id string, dt date"
SEGMENTS = "segment_id string, index string, bytes long, records long, start_ms long, end_ms long, crc32 long, written_ms long"
TEMPLATES = "segment_id string, template_id int, count long, content string, segs array<struct<kind:string,text:string,var:int>>"


class StoreError(RuntimeError):
    pass


@dataclass
class IndexConfig:
    """Thresholds of one index. Sizes accept ``64m`` and the like through ``from_options``."""

    flush_bytes: int = 64 << 20
    flush_records: int = 50_000
    flush_interval_ms: int = 3_000
    max_segments: int = 0
    max_disk_bytes: int = 0
    #: Kept for the listing: a checkpoint's log is written whole and synced in any case.
    wal_fsync: bool = False
    #: New files that a streaming batch takes at most (0: all that are there): the rest waits its turn.
    max_pending: int = 0

    @classmethod
    def from_options(cls, options: dict[str, str], env: dict[str, str] | None = None) -> "IndexConfig":
        """Options by name in any case; the environment overrides them."""
        given = {k.lower(): str(v) for k, v in options.items()} | {k.lower(): v for k, v in (env or {}).items()}
        out = cls()
        for f in fields(cls):
            if f.name in given:
                v = given[f.name]
                setattr(out, f.name, v.lower() in ("1", "true", "yes") if f.name == "wal_fsync" else size_bytes(v))
        return out


class FileStore:
    """Small files through Hadoop, so that any store that Spark reaches will do."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole file at once: written beside and renamed."""
        fs, p = self._at(path)
        _, tmp = self._at(path + ".tmp")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        fs.delete(p, False)
        if not fs.rename(tmp, p):
            raise StoreError(f"could not write {path}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        """A file or folder to another place, whose folder is made if need be."""
        (fs, p), (_, q) = self._at(path), self._at(to)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise StoreError(f"could not write {to}")

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class Catalog:
    """Indices by name under one root directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), FileStore(spark)

    # ------------------------------------------------------------------ indices

    def _load(self) -> dict[str, dict]:
        return json.loads(self.files.read(f"{self.root}/indices.json") or "{}")

    def _save(self, indices: dict[str, dict]) -> None:
        self.files.write(f"{self.root}/indices.json", json.dumps(indices, indent=1, sort_keys=True))

    def create(self, name: str, path: str | None = None, **options: str) -> None:
        """Create or update an index; options as in ``IndexConfig``."""
        if not name:
            raise StoreError("missing index")
        indices = self._load()
        old = indices.get(name, {})
        config = IndexConfig.from_options({**old.get("config", {}), **options})
        indices[name] = {"path": path or old.get("path") or f"{self.root}/{name}", "config": asdict(config)}
        self._save(indices)

    def delete(self, name: str) -> None:
        """Forget an index; its files stay."""
        indices = self._load()
        if indices.pop(name, None) is None:
            raise StoreError("unknown index")
        self._save(indices)

    def path(self, name: str) -> str:
        entry = self._load().get(name)
        if entry is None:
            raise StoreError("unknown index")
        return entry["path"]

    def config(self, name: str) -> IndexConfig:
        entry = self._load().get(name)
        if entry is None:
            raise StoreError("unknown index")
        return IndexConfig(**entry["config"])

    def indices(self) -> DataFrame:
        """index, path, and the thresholds."""
        rows = [(k, v["path"], *asdict(IndexConfig(**v["config"])).values()) for k, v in sorted(self._load().items())]
        return self.spark.createDataFrame(rows, "index string, path string, flush_bytes long, flush_records long, flush_interval_ms long, max_segments long, max_disk_bytes long, wal_fsync boolean, max_pending long")

    def stats(self) -> DataFrame:
        """index, segments, bytes, records."""
        names = sorted(self._load())
        every = [self.segments(n) for n in names]
        out = every[0] if every else self.spark.createDataFrame([], SEGMENTS)
        for df in every[1:]:
            out = out.union(df)
        got = out.groupBy("index").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))
        known = self.spark.createDataFrame([(n,) for n in names], "index string")
        return known.join(got, "index", "left").fillna(0).orderBy("index")

    def health(self) -> dict:
        return {"status": "ok", "indices": len(self._load())}

    def metrics(self) -> dict:
        """Counts of indices and of running ingest streams with their last progress."""
        active = [q for q in self.spark.streams.active if (q.name or "").startswith("ingest-")]
        limits = [IndexConfig(**v["config"]).max_pending for v in self._load().values()]
        return {"indices": len(limits), "writers": len(active), "workers": self.spark.sparkContext.defaultParallelism, "max_pending": max(limits, default=0), "pending": sum((q.lastProgress or {}).get("numInputRows", 0) for q in active)}

    # ----------------------------------------------------------------- segments

    def _table(self, name: str, part: str, schema: str) -> DataFrame:
        path = f"{self.path(name)}/{part}"
        if not self.files.names(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(*[f.split()[0] for f in schema.split(", ")])

    def segments(self, name: str) -> DataFrame:
        """One row for each segment that is there."""
        return self._table(name, "segments", SEGMENTS).join(self._table(name, "dropped", "segment_id string"), "segment_id", "left_anti")

    def templates(self, name: str) -> DataFrame:
        return self._table(name, "templates", TEMPLATES).join(self.segments(name).select("segment_id"), "segment_id", "left_semi")

    def lines(self, name: str) -> DataFrame:
        """All lines of visible segments. Filters on segment, day, time and template reach the scan."""
        if not self.files.exists(f"{self.path(name)}/lines"):
            raise StoreError("no segment")
        # A row for each segment, which goes to all tasks: by its key, a segment's lines would be one task's.
        seen = F.broadcast(self.segments(name).select("segment_id"))
        return self._table(name, "lines", LINES).join(seen, "segment_id", "left_semi")

    def write_segment(self, name: str, batch: DataFrame, segment_id: str, time_fallback=None, file_records: int = 0) -> dict:
        """Mine, match and store one batch of lines (column ``raw``) as a segment; returns its metadata."""
        (meta,) = self.write_segments(name, batch.withColumn("part", F.lit(0)), [segment_id], time_fallback, file_records)
        return meta

    def write_segments(self, name: str, batch: DataFrame, ids: list[str], time_fallback=None, file_records: int = 0) -> list[dict]:
        """Mine, match and store lines (columns ``raw`` and ``part``, the place of the line's segment in ``ids``); returns the segments' metadata.

        However many the segments, they take one pass each to mine, to store, and to read back. Writing
        the same segment again replaces it, whatever days its lines had the first time. All is written
        aside and then moved, the segments' rows last. Files hold ``file_records`` lines at most (0: as
        Spark deals them). Vars get a bloom filter, so that a search for one value skips row groups.
        """
        path, spark = self.path(name), self.spark
        place = lambda part, k: f"{path}/{part}/segment_id={ids[k]}"
        for part in ("segments", "templates", "lines"):
            there = set(self.files.names(f"{path}/{part}"))
            for k in range(len(ids)):
                if f"segment_id={ids[k]}" in there:
                    self.files.delete(place(part, k))
        templates = mining.mine_parts(batch)
        rows = mining.match(source.with_time(batch, time_fallback).select("part", "raw", "ts_ms", "ts"), templates)
        # Line numbers rise within each input split and do not need a global sort.
        rows = rows.withColumn("line_no", F.monotonically_increasing_id() + 1).withColumn("dt", F.to_date("ts"))
        columns = ["part int", *(f for f in LINES.split(", ") if not f.startswith("segment_id"))]
        aside = f"{path}/aside-{uuid.uuid4().hex}"
        try:
            writer = rows.select(*(f.split()[0] for f in columns)).write.option("compression", "zstd").option("parquet.bloom.filter.enabled#vars.list.element", "true")
            if file_records:
                writer = writer.option("maxRecordsPerFile", file_records)
            writer.partitionBy("part", "dt").parquet(f"{aside}/lines")
            # Only what was written is read back, once: each template's share of each segment.
            stored = spark.read.schema(", ".join(columns)).parquet(f"{aside}/lines")
            shares = stored.groupBy("part", "template_id").agg(
                F.sum(F.octet_length("raw") + 1).alias("bytes"), F.count("*").alias("records"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.bit_xor(line_crc(F.col("raw"))).alias("crc32")
            )
            held: dict[int, list] = {}
            for r in shares.collect():
                held.setdefault(r["part"], []).append(r)
            now, metas, texts, notes = int(time.time() * 1000), [], [], []
            for k, segment_id in enumerate(ids):
                if k not in held:  # no lines leave nothing
                    metas.append({"segment": None, "records": 0})
                    continue
                of = lambda f, k=k: [r[f] for r in held[k] if r[f] is not None]
                meta = {"records": sum(of("records")), "bytes": sum(of("bytes")), "start_ms": min(of("start_ms")), "end_ms": max(of("end_ms")), "crc32": reduce(xor, of("crc32"), 0)}
                metas.append({"segment": segment_id, **meta})
                row = {"index": name, **meta, "written_ms": now}
                notes.append((k, *(row[f.split()[0]] for f in SEGMENTS.split(", ") if not f.startswith("segment_id"))))
                counts = {r["template_id"]: r["records"] for r in held[k]}
                known = {i: t for t, i in mining.numbered(templates.get(k, [])).items() if i in counts}
                texts += [(k, i, counts[i], known[i].content, mining.segments(known[i])) for i in sorted(known, key=lambda i: (-counts[i], i))]
            if not held:
                return metas
            self._aside(texts, TEMPLATES, f"{aside}/templates")
            self._aside(notes, SEGMENTS, f"{aside}/segments")
            if self.files.exists(f"{path}/dropped"):  # a segment that was dropped and is written again is there again
                gone = {r[0] for r in self._table(name, "dropped", "segment_id string").distinct().collect()}
                if again := gone & {ids[k] for k in held}:
                    spark.createDataFrame([(s,) for s in sorted(gone - again)], "segment_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/dropped")
            for part in ("lines", "templates", "segments"):
                there = set(self.files.names(f"{aside}/{part}"))
                for k in sorted(held):
                    if f"part={k}" in there:
                        self.files.move(f"{aside}/{part}/part={k}", place(part, k))
        finally:
            self.files.delete(aside)
        return metas

    def _aside(self, rows: list[tuple], schema: str, path: str) -> None:
        """Rows of a dimension, the part first, into a folder for each part."""
        df = self.spark.createDataFrame(rows, ", ".join(["part int", *(f for f in schema.split(", ") if not f.startswith("segment_id"))]))
        (df if len(rows) > 1_000 else df.coalesce(1)).write.partitionBy("part").parquet(path)

    def verify(self, name: str) -> DataFrame:
        """segment_id and whether its stored lines still give the recorded count and checksum."""
        now = self.lines(name).groupBy("segment_id").agg(F.count("*").alias("n"), F.bit_xor(line_crc(F.col("raw"))).alias("crc"))
        return self.segments(name).join(now, "segment_id", "left").select("segment_id", ((F.col("n") == F.col("records")) & (F.col("crc") == F.col("crc32"))).alias("ok"))

    def retain(self, name: str) -> list[str]:
        """Drop the oldest segments beyond the index's count or bytes; returns their ids.

        Only directories of this index's own segments are deleted.
        """
        config = self.config(name)
        gone = [r[0] for r in expired(self.segments(name), config.max_segments, config.max_disk_bytes).select("segment_id").collect()]
        if not gone:
            return []
        path = self.path(name)
        # The ids are noted first: a segment is out of sight before its files go.
        self.spark.createDataFrame([(s,) for s in gone], "segment_id string").coalesce(1).write.mode("append").parquet(f"{path}/dropped")
        for s in gone:
            self.files.delete(f"{path}/lines/segment_id={s}")
        return gone

    # ------------------------------------------------------------------ aliases

    def set_aliases(self, name: str, aliases: Aliases, segment: str | None = None) -> None:
        where = f"aliases-{segment}.conf" if segment else "aliases.conf"
        self.files.write(f"{self.path(name)}/{where}", aliases.dump())

    def aliases(self, name: str, segment: str | None = None) -> Aliases:
        own = self.files.read(f"{self.path(name)}/aliases-{segment}.conf") if segment else None
        return Aliases.parse(own or self.files.read(f"{self.path(name)}/aliases.conf") or "")

    def scopes(self, name: str) -> dict[str, Aliases]:
        """Aliases of the segments that have their own."""
        found = {}
        for file in self.files.names(self.path(name)):
            if file.startswith("aliases-") and file.endswith(".conf"):
                segment = file.removeprefix("aliases-").removesuffix(".conf")
                found[segment] = self.aliases(name, segment)
        return found

    def dump_values(self, name: str, path: str) -> None:
        """Every variable's column as text, one folder for each segment, template and variable; constants are in the templates."""
        held = mining.variables(self.lines(name))
        held.select("segment_id", "template_id", "var_idx", "value").write.mode("overwrite").partitionBy("segment_id", "template_id", "var_idx").text(path)

    def export(self, name: str, path: str) -> None:
        """All lines back to text files, one directory for each segment."""
        self.lines(name).select("segment_id", "raw").write.mode("overwrite").partitionBy("segment_id").text(path)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``; only a local master may do without that. It goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="sawmill-")
    path = f"{shared}/index-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        FileStore(spark).delete(path)
    except Exception:  # noqa: BLE001 - the session may already be gone at exit
        pass


def expired(segments: DataFrame, max_segments: int, max_bytes: int) -> DataFrame:
    """Segments beyond the newest ``max_segments`` or the newest ``max_bytes`` (0: no limit). Segments are a small dimension."""
    order = Window.partitionBy("index").orderBy(F.desc("end_ms"), F.desc("segment_id"))
    ranked = segments.withColumn("place", F.row_number().over(order)).withColumn("held", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.lit(False)
    if max_segments > 0:
        over = over | (F.col("place") > max_segments)
    if max_bytes > 0:
        over = over | (F.col("held") > max_bytes)
    return ranked.where(over).drop("place", "held")
