"""Shared helpers: written intermediates, document blocks, vectorised byte hashing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.session import checkpoint_root, ship_package

#: White space of the word and line rules: space and \t \n \v \f \r.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: A missing doc_id inside numpy code; it orders after every real id.
NO_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage with a copy that outlives executors.  The shuffle files behind
    the write are released as soon as it has ended: the written table replaces them.
    ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete a table written by :func:`kept` that no later plan reads."""
    spark = df.sparkSession
    root = checkpoint_root(spark).split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ready(spark: SparkSession) -> None:
    """Let executors import this package (a no-op where they can already)."""
    ship_package(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- blocks: many documents per row, so that numpy works on megabytes at once -------------

BLOCK_SCHEMA = "block long, n_bytes long, ids binary, ends binary, text binary"


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def id_array(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def gather(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Rows (id, text) as (ids, ends, body) of about ``limit`` bytes: the texts joined by \n, in
    ascending id order; ends has the offset of each text's end."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def made():
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        ends = np.cumsum([len(texts[i]) + 1 for i in order], dtype=np.int64) - 1
        return np.array([ids[i] for i in order], np.int64), ends, b"\n".join(texts[i] for i in order)

    for batch in batches:
        for i, x in zip(id_array(batch.column(0)).tolist(), text_bytes(batch.column(1)), strict=True):
            ids.append(i)
            texts.append(x)
            size += len(x) + 1
            if size >= limit:
                yield made()
                ids, texts, size = [], [], 0
    if ids:
        yield made()


def starts_of(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext
    squeeze, task = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
    for made, (ids, ends, body) in enumerate(gather(batches)):
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([task << 32 | made], pa.int64()), "n_bytes": pa.array([len(body)], pa.int64()),
            "ids": [ids.tobytes()], "ends": [ends.tobytes()], "text": [squeeze.compress(body)]})


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written blocks of about 4 MB of text each: ids (int64, ascending inside the block),
    ends (int64 offset of each text's end; texts are joined by one \\n) and the zstd text."""
    ready(docs.sparkSession)
    return kept(id_text(docs, id_col, text_col).mapInArrow(_pack, BLOCK_SCHEMA), "blocks")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


class Block:
    """One row of :func:`text_blocks`, decoded."""

    def __init__(self, ids: bytes, ends: bytes, text: bytes):
        import zstandard
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.frombuffer(ends, np.int64)
        self.starts = starts_of(self.ends)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)


def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("block", "ids", "ends", "text")]
        for n, ids, ends, text in zip(*cols, strict=True):
            yield n, Block(ids, ends, text)


# --- polynomial hashes of substrings through prefix sums, mod 2^64 -------------------------
# For short strings: there are texts of some hundred bytes that collide for every base.

SEGMENT = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class Hasher:
    """Keyed hash of any substring of a byte buffer after one pass over it."""

    def __init__(self, seed: int, lower: bool = False):
        draw = np.random.default_rng(seed)
        table = draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            table[65:91] = table[97:123]
        self.table = table
        self.base = int(draw.integers(1 << 40, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-space bytes) of a buffer."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SPACE_BYTES[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_segments(data: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces (offset, bytes) of a buffer that are cut at white space only."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data):
            space = np.flatnonzero(SPACE_BYTES[data[end:end + limit]])
            if len(space):
                end += int(space[0])
                break
            end = min(len(data), end + limit)
        yield at, data[at:end]
        at = end


_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def hashed_words(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of a buffer; ``lower`` takes A-Z as a-z.

    Arrow finds the distinct words byte for byte, and each gets a cryptographic
    hash: no text can be made up in which different words collide."""
    parts = []
    for at, piece in word_segments(data):
        s, e = word_bounds(piece)
        packed = (_LOWER[piece] if lower else piece)[~SPACE_BYTES[piece]]
        offsets = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        digests = b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist()])
        parts.append((s + at, e + at, np.frombuffer(digests, "<u8").astype(np.uint64)[words.indices.to_numpy(zero_copy_only=False)]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- native helpers -------------------------------------------------------------------------

def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c):
    """A-Z to a-z and nothing else.  All-ASCII strings take the engine's quick lower()."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, up, low))
