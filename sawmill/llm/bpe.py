"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Method. Texts are cut into pre-tokens; the positions of each block of documents are kept as
indexes into the block's own word list. The word lists (not the texts, not one row per
occurrence) are shuffled by word, so that each distinct word of the whole corpus meets one task
and is encoded once there. The ids travel back by block and are laid out by position again.
Decoding joins the table of token bytes, whose size is that of the vocabulary file.

A word that makes a third of the corpus is one entry per block, so no task sees more than one
row for each block of it. Blocks hold ``BLOCK_CHARS`` characters (or one longer text), which
bounds every task's memory.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of text in one block.
BLOCK_CHARS = 14_000_000
#: Characters of a text from which on its words are cut one by one instead of as a list.
LONG_TEXT = 200_000
#: Words whose ids a task remembers (some 150 bytes each); tasks are enough that few meet more.
KNOWN_WORDS = 1_000_000
#: Bytes of ids in one frame that goes back to Spark.
FRAME_BYTES = 1_000_000
_MID = "block binary, to int, kind int, doc_ids binary, nulls binary, sizes binary, data binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file (base64 token, rank) of a public byte-level vocabulary. It is read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _varints(x: np.ndarray) -> bytes:
    """Numbers below 2**23 as two planes: low 7 bits of each, then the higher 16 bits of those that need them."""
    low = (x & 0x7F).astype(np.uint8)
    more = x > 0x7F
    low[more] |= 0x80
    return low.tobytes() + (x[more] >> 7).astype(np.uint16).tobytes()


def _from_varints(raw: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8, n)
    out = (low & 0x7F).astype(np.int64)
    out[low > 0x7F] |= np.frombuffer(raw[n:], np.uint16).astype(np.int64) << 7
    return out


def _pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers, most of them small, in few bytes."""
    wide = len(x) and int(x.max()) >= 1 << 23
    head = np.array([len(x), bool(wide)], np.int64).tobytes()
    return _pack(head + (x.astype(np.int64).tobytes() if wide else _varints(x)))


def _unpack_numbers(raw: bytes) -> np.ndarray:
    raw = _unpack(raw)
    n, wide = np.frombuffer(raw[:16], np.int64)
    return np.frombuffer(raw[16:], np.int64) if wide else _from_varints(raw[16:], int(n))


def _split(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _blocks(pattern: str, n_to: int):
    """documents -> per block one row of positions (kind 0) and one row per word task (kind 1)."""

    def run(batches):
        import regex

        compiled = regex.compile(pattern)
        ids: list = []
        sizes: list[int] = []
        seen: dict[str, int] = {}
        flat = array("i")
        held = 0

        def cut(t: str) -> None:
            """Texts are cut as they come: a block holds its words and positions, no texts."""
            before = len(flat)
            code = seen.setdefault
            if len(t) <= LONG_TEXT:
                flat.extend([code(p, len(seen)) for p in compiled.findall(t)])
            else:
                flat.extend(code(m.group(), len(seen)) for m in compiled.finditer(t))
            sizes.append(len(flat) - before)

        def flush():
            at = np.frombuffer(flat, np.int32)
            count = np.bincount(at, minlength=len(seen))
            order = np.argsort(-count, kind="stable")  # frequent words get small numbers
            del count
            rank = np.empty(len(seen), np.int32)
            rank[order] = np.arange(len(seen))
            spelled = [w.encode("utf-8", "surrogatepass") for w in seen]
            words = [spelled[i] for i in order]
            at = rank[at]
            some = np.array([x is not None for x in ids], np.uint8)
            doc_ids = np.array([x or 0 for x in ids], np.int64)
            head = xxhash.xxh3_128()
            for part in (doc_ids, some, np.array(sizes, np.int64), at, b"\0".join(words)):
                head.update(part)
            block = head.digest()
            rows = [(block, int.from_bytes(block[:4], "little") % n_to, 0, doc_ids.tobytes(), some.tobytes(), _pack_numbers(np.array(sizes, np.int64)), _pack_numbers(at))]
            to = np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64) % n_to
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(n_to + 1))
            for k in range(n_to):
                mine = by[cuts[k] : cuts[k + 1]]
                if len(mine):
                    spelt = [words[i] for i in mine]
                    index = _pack_numbers(np.diff(mine, prepend=0))  # by rising rank, as steps
                    rows.append((block, k, 1, index, None, _pack_numbers(np.array([len(w) for w in spelt], np.int64)), _pack(b"".join(spelt))))
            return pd.DataFrame(rows, columns=["block", "to", "kind", "doc_ids", "nulls", "sizes", "data"])

        for pdf in batches:
            for i, missing, t in zip(pdf["doc_id"].tolist(), pdf["missing"].tolist(), pdf["text"].tolist()):
                ids.append(None if missing else i)
                cut(t)
                held += len(t) + 16
                if held >= BLOCK_CHARS:
                    made = flush()
                    ids, sizes, seen, flat, held = [], [], {}, array("i"), 0
                    common.release()
                    yield made
        if ids:
            yield flush()

    return run


def _encode_words(ranks, pattern):
    """Word rows -> rows of ids. All rows of a word come to one task, which encodes it once as long as its cache holds it."""

    def run(batches):
        encode = _encoder(ranks.value, pattern)
        known: dict[bytes, np.ndarray] = {}
        for pdf in batches:
            out = []
            for block, to, kind, doc_ids, nulls, sizes, data in pdf.itertuples(index=False, name=None):
                if kind == 1:
                    got = []
                    for w in _split(_unpack(data), _unpack_numbers(sizes)):
                        x = known.get(w)
                        if x is None:
                            if len(known) >= KNOWN_WORDS:
                                known.clear()
                            x = known[w] = np.array(encode(w), np.uint32).tobytes()
                        got.append(x)
                    sizes = _pack_numbers(np.array([len(x) // 4 for x in got], np.int64))
                    data = _pack_numbers(np.frombuffer(b"".join(got), np.uint32).astype(np.int64))
                out.append((block, to, kind, doc_ids, nulls, sizes, data))
            yield pd.DataFrame(out, columns=pdf.columns)

    return run


def _lay_out(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One block: ids of its words and positions of its documents -> ids of each document, in small frames."""
    parts, head, seen = [], [], set()
    for pdf in pieces:
        for to, kind, doc_ids, nulls, sizes, data in pdf[["to", "kind", "doc_ids", "nulls", "sizes", "data"]].itertuples(index=False, name=None):
            if kind == 0:
                head.append((doc_ids, nulls, sizes, data))
            elif to not in seen:  # equal blocks (repeated rows) share one word list, and come with a row of positions each
                seen.add(to)
                parts.append((np.cumsum(_unpack_numbers(doc_ids)), _unpack_numbers(sizes), _unpack_numbers(data).astype("<u4")))
    n_words = sum(len(p[0]) for p in parts)
    size, start = np.zeros(n_words, np.int32), np.zeros(n_words, np.int64)
    held = 0
    for at, s, x in parts:
        size[at] = s
        start[at] = held + np.cumsum(s) - s
        held += len(x)
    table = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, "<u4")
    parts.clear()
    out: dict[str, list] = {"doc_id": [], "ids": []}

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out | {"doc_id": pd.array(out["doc_id"], dtype="Int64")})
        for values in out.values():
            values.clear()
        return made

    for doc_ids, nulls, sizes, data in head:
        at = _unpack_numbers(data).astype(np.int32)
        a = bytes_held = 0
        ends = np.cumsum(_unpack_numbers(sizes)).tolist()
        for i, ok, b in zip(np.frombuffer(doc_ids, np.int64).tolist(), np.frombuffer(nulls, np.uint8).tolist(), ends):
            w = at[a:b]
            a = b
            s = size[w].astype(np.int64)
            ids = table[np.repeat(start[w] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))].tobytes()
            out["doc_id"].append(i if ok else None)
            out["ids"].append(ids)
            bytes_held += len(ids)
            if bytes_held >= FRAME_BYTES:
                yield frame()
                bytes_held = 0
        if out["ids"]:
            yield frame()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encode ``text`` of every row: (doc_id long, ids binary: little-endian unsigned 32-bit).

    Null and empty texts give empty ids. Repeated rows stay repeated; null ids stay null; other
    columns are ignored. An empty table gives an empty table. Positions ride through the shuffle of
    words: writing them apart would cost more disk, and cutting the texts twice more time.
    """
    docs = common.in_small_batches(docs)
    spark = docs.sparkSession
    n_to = max(8, common.partitions(spark))
    shared = spark.sparkContext.broadcast(ranks)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNull().alias("missing"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).mapInPandas(common.releasing(_blocks(pattern, n_to)), _MID)
    ids = rows.repartition(n_to, "to").mapInPandas(common.releasing(_encode_words(shared, pattern), None), _MID)

    def finish(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _lay_out(pieces)
        common.release()

    return ids.groupBy("block").applyInPandas(finish, "doc_id long, ids binary")


class TokenBytes:
    """The token-byte table as two columns by id: where a token's bytes begin, and how many they are."""

    def __init__(self, ranks: dict[bytes, int]):
        spelled = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            spelled[i] = token
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def join(self, ids: bytes) -> bytes:
        """The bytes of a sequence of ids, joined to the table by id and put together by position."""
        at = np.frombuffer(ids, "<u4")
        n = self.size[at]
        return self.bytes[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Join the token-byte table to ``ids`` by id: adds ``decoded`` binary; null ids decode to null. Other columns but doc_id go.

    The table is the vocabulary file's, so its size is known before it is sent (about 1 MB).
    """
    shared = encoded.sparkSession.sparkContext.broadcast(TokenBytes(ranks))

    def run(batches):
        table = shared.value
        for pdf in batches:
            yield pdf.assign(decoded=[None if x is None else table.join(x) for x in pdf["ids"]])

    slim = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    return slim.mapInPandas(common.releasing(run, "ids"), "doc_id string, ids binary, decoded binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest of encoding and decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks, pattern = default_vocabulary()
    return decode(encode(docs, ranks, pattern), ranks).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
