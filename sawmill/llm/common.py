"""Shared plumbing: the shared work folder, written tables, label splits, connected components."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the data contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@functools.lru_cache(maxsize=8)
def _local_dir(app_id: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"work-{app_id}-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, whose executors are the driver itself, may do without it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    return _local_dir(spark.sparkContext.applicationId)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may already be gone at exit
        pass


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table survives lost executors. It is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts (Spark bounds its bytes by 64 MB), and characters that a batch
#: function gets at once (or one longer text).
BATCH_ROWS, FRAME_CHARS = 1_000, 4_000_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same frame in a clone of its session whose Arrow batches hold BATCH_ROWS at most.

    Texts go to Python in such batches; the settings of the caller's session stay as they are.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        return df
    clone = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    clone.conf.set(key, str(BATCH_ROWS))
    rows = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(clone._jsparkSession, df._jdf.queryExecution().logical())
    return type(df)(rows, clone)


def small_frames(batches, column: str = "text", chars: int = FRAME_CHARS):
    """The batches cut into frames of bounded text, whatever the session's Arrow settings (64 MB a batch by default)."""
    for pdf in batches:
        size = np.fromiter((0 if x is None else len(x) for x in pdf[column]), np.int64, len(pdf))
        if int(size.sum()) <= chars:
            yield pdf
            continue
        part = (np.cumsum(size) - size) // chars
        for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(part)) + 1):
            yield pdf.iloc[at[0] : at[-1] + 1]


def release() -> None:
    """Give freed memory of a Python worker back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run, column: str = "text"):
    """A batch function over texts that gets them in small frames and gives its memory back at the end of a task.

    What an earlier function left in the worker is given back before.
    """

    def wrapped(batches):
        release()
        try:
            yield from run(small_frames(batches, column) if column else batches)
        finally:
            release()

    return wrapped


def releasing_groups(run, column: str, size: int = 2_000_000):
    """A function of one group that gives its memory back after groups whose ``column`` holds more than ``size`` bytes."""

    def wrapped(pdf: pd.DataFrame) -> pd.DataFrame:
        held = sum(map(len, pdf[column]))
        try:
            return run(pdf)
        finally:
            if held > size:
                release()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_bucket(doc_id: str | Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; remainder 2 is held out of every fit."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def held_out(doc_id: str | Column) -> Column:
    return id_bucket(doc_id) == 2


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out fold, least hash first: (doc_id, label).

    Several rows of one id count once (largest label); null ids and labels are skipped.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows and bytes of a table that is sent to every task; both are counted before.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 4_000_000


def text_hash(text: str | Column = "text") -> Column:
    """With the id it names a row: 64 bits of a text, null taken as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(c.cast("string"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text_hash) is not in ``gone``, all columns kept; rows without an id stay.

    The pairs are written first and counted: up to BROADCAST_ROWS of them (16 bytes each) are sent
    to every task, more go through a shuffled anti-join.
    """
    name, text = fresh(docs, "gone"), fresh(docs, "gone_text")
    gone = written(gone.toDF(name, text).where(F.col(name).isNotNull()).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[name]) & (text_hash(docs["text"]) == gone[text]), "left_anti")


def join_texts(texts: DataFrame, places: DataFrame, keys: list[str], size: Column, how: str = "inner", most: int | None = None) -> DataFrame:
    """``texts`` joined with ``places``, a written table; ``size`` is the bytes of a row of it.

    Places are counted first. Up to ``most`` bytes (BROADCAST_BYTES) are sent to every task and no
    text moves. Of more, their keys are sent as far as BROADCAST_ROWS allow, and only texts with a
    place are shuffled.
    """
    rows, held = places.agg(F.count("*"), F.coalesce(F.sum(size + 48), F.lit(0))).first()
    if held <= (BROADCAST_BYTES if most is None else most):
        return texts.join(F.broadcast(places), keys, how)
    if rows <= BROADCAST_ROWS:
        wanted = F.broadcast(places.select(*keys))
        joined = texts.join(wanted, keys, "left_semi").join(places.hint("shuffle_merge"), keys)
        if how == "inner":
            return joined
        rest = texts.join(wanted, keys, "left_anti")
        return joined.unionByName(rest, allowMissingColumns=True)
    return texts.join(places, keys, how)


# ------------------------------------------------------------- connected components


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union the edges a[i]-b[i]; returns the nodes seen and the smallest node each can reach."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller one, then halve paths
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        if (lo == hi).all():
            return nodes, nodes[root]
        np.minimum.at(root, hi, lo)
        while (up := root[root]).tolist() != root.tolist() if len(root) < 64 else not np.array_equal(up := root[root], root):
            root = up


def _local_forest(batches):
    """Per task, edges become stars to the smallest id that the task knows of; memory is bounded by flushing."""
    a, b, held = [], [], 0
    for pdf in batches:
        a.append(pdf["a"].to_numpy())
        b.append(pdf["b"].to_numpy())
        held += len(pdf)
        if held >= 1_000_000:
            n, r = roots(np.concatenate(a), np.concatenate(b))
            a, b = [n[n != r]], [r[n != r]]
            if len(a[0]) >= 500_000:
                yield pd.DataFrame({"a": a[0], "b": b[0]})
                a, b = [], []
            held = sum(map(len, a))
    if a:
        n, r = roots(np.concatenate(a), np.concatenate(b))
        yield pd.DataFrame({"a": n[n != r], "b": r[n != r]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component = smallest node reachable).

    Only nodes with an edge appear. Each round is a large-star and a small-star step written as
    ``min`` aggregates (which combine before the shuffle, so that a hub costs one row per task)
    and an equi-join that adaptive execution splits when a hub is hot. Rounds are written tables,
    so a lost executor does not restart the loop. Every round lowers some node's smallest neighbour
    until nothing changes, so the loop ends; rounds grow with the logarithm of the nodes.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = written(e.mapInPandas(_local_forest, "a long, b long").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small_in = large.distinct()  # each (a, b) has b < a
        low2 = small_in.groupBy("a").agg(F.min("b").alias("m"))
        small = small_in.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b")
        e = written(small.distinct(), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    stars = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
