"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` numbers) is planned
on: an index of available single, pair and triple length sums finds the
combinations that fill a gap exactly; where none does, the largest piece that
fits goes in first (best fit).  A found pattern is consumed as often as its
lengths last.  The pieces then take the plan's places by their rank within
their length, each task looking its own rows up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import gather, id_column, id_text, kept, ready
from corpusgrid.llm.word_tokens import vocabulary_path, word_ids

CAPACITY = 4096
SALTS = 64
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Each text's ids with ``end_id``, cut into pieces of at most ``capacity``: doc_id, piece, start,
    length and ids (unsigned 32-bit little-endian).  Null and empty texts are the end id alone."""
    ready(docs.sparkSession)
    path = path or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for ids, ends, body in gather(batches):
            tokens, at = encoder.encode(ends, body, end_id)
            rows = [(d, k, s, min(capacity, n - s), a + s) for d, a, n in
                    zip(range(len(ids)), at[:-1].tolist(), np.diff(at).tolist(), strict=True)
                    for k, s in enumerate(range(0, n, capacity))]
            which, piece, start, length, where = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([
                id_column(ids[which]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                pa.array([tokens[a:a + n].tobytes() for a, n in zip(where.tolist(), length.tolist(), strict=True)], pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


class _Sums:
    """Which sums one, two or three available lengths reach, and a combination that does."""

    def __init__(self, free: np.ndarray):
        self.free = free
        self.stamp: bytes | None = None

    def refresh(self) -> None:
        here = np.flatnonzero(self.free > 0)
        stamp = here.tobytes()
        if stamp != self.stamp:
            self.stamp, self.here = stamp, here
            bits = 0
            for a in here.tolist():
                bits |= 1 << a
            sums, limit = 0, (1 << len(self.free)) - 1
            for a in here.tolist():
                sums |= (bits << a) & limit
            raw = np.frombuffer(sums.to_bytes((len(self.free) + 7) // 8, "little"), np.uint8)
            self.pairs = np.unpackbits(raw, bitorder="little")[:len(self.free)].astype(bool)

    def pair(self, gap: int, free: np.ndarray) -> list[int] | None:
        """The pair of length sum ``gap`` that can be taken most often."""
        if gap < 2:
            return None
        low = np.arange(1, gap // 2 + 1)
        n = np.minimum(free[low], free[gap - low])
        if gap % 2 == 0:
            n[-1] = free[gap // 2] // 2
        k = int(n.argmax())
        return [gap - int(low[k]), int(low[k])] if n[k] > 0 else None

    def exact(self, gap: int, used: Counter) -> list[int] | None:
        free = self.free
        if used:
            free = free.copy()
            for a, k in used.items():
                free[a] -= k
        if free[gap] > 0:
            return [gap]
        if self.pairs[gap] and (two := self.pair(gap, free)):
            return two
        first = self.here[self.here < gap]
        for a in first[self.pairs[gap - first]][::-1].tolist():
            if free[a] > 0:
                free[a] -= 1
                two = self.pair(gap - a, free)
                free[a] += 1
                if two:
                    return [a, *two]
        return None


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, number of such sequences), consuming the histogram whole."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        free[length] += n
    out: list[tuple[list[int], int]] = []
    sums = _Sums(free)
    while free.any():
        sums.refresh()
        lengths: list[int] = []
        used: Counter = Counter()
        gap = capacity
        while gap > 0:
            more = sums.exact(gap, used) if lengths else None
            if not more:
                fits = sums.here[:np.searchsorted(sums.here, gap, "right")][::-1]
                best = next((a for a in fits.tolist() if free[a] > used[a]), None)
                if best is None:
                    break
                more = [best]
            lengths += more
            used.update(more)
            gap -= sum(more)
        n = min(int(free[a]) // k for a, k in used.items())
        for a, k in used.items():
            free[a] -= n * k
        out.append((lengths, n))
    return out


def plan_slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Per length, ascending rank ranges: key = length * 2^40 + first rank, with sequence and offset there."""
    taken: Counter = Counter()
    rows, base = [], 0
    for lengths, n in patterns:
        offset = 0
        for a in lengths:
            rows.append((a << 40 | taken[a], base, offset))
            taken[a] += n
            offset += a
        base += n
    rows.sort()
    key, seq, off = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return {"key": key, "sequence": seq, "offset": off}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to ``capacity``).

    Other columns pass through.  Rows that repeat (doc_id, piece) are packed
    each on its own; null ids rank last.  No rows, no sequences.
    """
    spark = pieces.sparkSession
    ready(spark)
    # at most `capacity` rows reach the driver, whatever the input's size
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan_slots(plan_patterns(histogram, capacity)))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("__length"), F.col("__salt").alias("__s"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = Window.partitionBy("length", "__salt").orderBy(F.col("doc_id").asc_nulls_last(), "piece")
    # at most capacity * SALTS rows are broadcast
    ranked = (salted.withColumn("__rank", F.row_number().over(rank))
              .join(F.broadcast(counts), (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__s")))
              .withColumn("__rank", F.col("__rank") - 1 + F.col("__before")).drop("__salt", "__length", "__s", "__before"))
    names = [c for c in ranked.columns if c != "__rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            at = np.searchsorted(s["key"], length << 40 | r, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(s["sequence"][at] + r - (s["key"][at] & ((1 << 40) - 1))), pa.array(s["offset"][at])],
                names=[*names, "sequence_id", "offset"])

    schema = ranked.drop("__rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                     **options) -> DataFrame:
    """Pieces of all texts with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = (token_pieces(docs, id_col, text_col, capacity=capacity, **options)
              .withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pack(kept(pieces, "pieces"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
