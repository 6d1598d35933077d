"""Removal of repeated substrings by blockwise suffix sorting with a difference cover.

The suffixes that start at the positions of a difference cover (offset mod 57)
are ranked first: a sampled suffix whose 44 leading bytes occur once in the
corpus is proved unique.  Any two equal 100-byte strings meet in a sampled pair
within their first 57 bytes, so a suffix without a repeated sample there cannot
tie that long and is never sorted.  The others are dealt into suffix buckets by
fingerprint and each bucket is sorted on its own, ties broken by document and
position; a bucket is the most that a task holds.  Buckets are worked off in a
few passes, so that only one share of the suffixes is on disk at a time.  Every
suffix but the first of its tie marks its 100 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm import buckets as B
from corpusgrid.llm.common import SEGMENT, Block, Hasher, id_column, kept, shuffle_partitions, text_blocks

#: Bytes of a removable string.
LENGTH = 100
#: A perfect difference set: every residue mod 57 is a difference of two of them.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
_SAMPLE, _FIRST, _SECOND = Hasher(101), Hasher(102), Hasher(103)
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
_ENTRY = np.dtype([("h2", "<u4"), ("id", "<i8")])
#: Bytes that a suffix takes on its way to its bucket, and bytes a pass may move for each byte of text.
SUFFIX_BYTES = 6 + _ENTRY.itemsize
PASS_SHARE = 1.0
REGIONS = "block long, n_suffixes long, ids binary, ends binary, text binary, rows binary, bases binary"
ROWS = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _segments(block: Block, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, bytes from `from` to `to` + reach) over a block."""
    n = len(block.text)
    for a in range(0, n, SEGMENT):
        z = min(n, a + SEGMENT)
        yield a, z, block.text[a:min(n, z + reach)]


def _samples(block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of all texts whose ``length - PERIOD + 1`` bytes fit, and their hashes."""
    w = length - PERIOD + 1
    at, h = [], []
    for a, z, data in _segments(block, w):
        lo, hi = np.searchsorted(block.ends, [a, z], "left")
        texts = np.arange(lo, min(hi + 1, len(block.ends)))
        s, e = np.maximum(block.starts[texts], a), np.minimum(block.ends[texts] - w + 1, z)
        n = np.maximum(e - s, 0)
        p = np.arange(n.sum()) + np.repeat(s - np.cumsum(n) + n, n)
        p = p[_IN_COVER[(p - np.repeat(block.starts[texts], n)) % PERIOD]]
        at.append(p)
        h.append(_SAMPLE.of(_SAMPLE.prefix(data), p - a, p - a + w))
    return (np.concatenate(at), np.concatenate(h)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _candidates(block: Block, samples: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (from, to) of the positions that have one of the (ascending) repeated ``samples`` in
    their first PERIOD bytes."""
    text = np.searchsorted(block.ends, samples)
    lo = np.maximum(samples - PERIOD + 1, block.starts[text])
    hi = np.minimum(samples, block.ends[text] - length)
    lo, hi = lo[hi >= lo], hi[hi >= lo]
    if not len(lo):
        return lo, hi
    new = np.concatenate([[True], lo[1:] > hi[:-1] + 1])
    new[1:] |= block.ends[np.searchsorted(block.ends, lo[:-1])] < lo[1:]
    return lo[new], hi[np.concatenate([new[1:], [True]])] + 1


def _repeated_samples(block: Block, answer, buckets: int, length: int) -> np.ndarray:
    at, h = _samples(block, length)
    keys, back, count = np.unique(B.bucket_keys(h, buckets), return_inverse=True, return_counts=True)
    far = B.answered(keys, [x["bucket"] for x in answer or []], [x["bits"] for x in answer or []], np.uint8)
    return at[((count > 1) | (far > 0))[back]]


class _Sorted:
    """The candidate suffixes of a block's regions in the buckets from ``low`` to ``high``, in fingerprint
    order; ``first`` marks one per fingerprint."""

    def __init__(self, regions: Block, rows: np.ndarray, buckets: int, low: int, high: int, length: int):
        found = []
        for a, z, data in _segments(regions, length):
            lo, hi = np.searchsorted(regions.ends, [a, z], "left")
            these = np.arange(lo, min(hi + 1, len(regions.ends)))
            s, e = np.maximum(regions.starts[these], a), np.minimum(regions.ends[these] - length + 1, z)
            n = np.maximum(e - s, 0)
            p = np.arange(n.sum()) + np.repeat(s - np.cumsum(n) + n, n)
            key = B.bucket_keys(_FIRST.of(_FIRST.prefix(data), p - a, p - a + length), buckets)
            mine = (key >= np.uint64(low << 48)) & (key < np.uint64(high << 48))
            p, key = p[mine], key[mine]
            found.append((p, key, (_SECOND.of(_SECOND.prefix(data), p - a, p - a + length) >> np.uint64(32)).astype(np.uint32)))
        at, key, h2 = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (
            np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.lexsort((h2, key))                      # stable: ties stay in (id, position) order
        self.at, self.key, self.h2 = at[order], key[order], h2[order]
        region = np.searchsorted(regions.ends, self.at)
        self.row, self.id = rows[region], regions.ids[region]
        self.first = np.ones(len(at), bool)
        self.first[1:] = (self.key[1:] != self.key[:-1]) | (self.h2[1:] != self.h2[:-1])

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(int(self.first.sum()), _ENTRY)
        out["h2"], out["id"] = self.h2[self.first], self.id[self.first]
        return self.key[self.first], out

    def repeated(self, answer) -> np.ndarray:
        """Positions that an earlier equal string precedes; the answer says which an earlier document elsewhere has."""
        if not len(self.at):
            return self.at
        far = B.answered(self.key[self.first], [x["bucket"] for x in answer], [x["bits"] for x in answer], np.uint8) > 0
        group = np.cumsum(self.first) - 1
        same_row = np.zeros(len(self.at), bool)
        same_row[1:] = ~self.first[1:] & (self.row[1:] == self.row[:-1])
        return self.at[same_row | (self.id > self.id[self.first][group]) | far[group]]


def _with_answers(table: DataFrame, answers: DataFrame) -> DataFrame:
    return table.join(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("got")), "block", "left")


def _region_rows(b: Block, number: int, lo: np.ndarray, hi: np.ndarray, length: int) -> pa.RecordBatch:
    """The candidate ranges of a block as texts of their own, each with its row and place there."""
    import zstandard
    body = b.text.tobytes()
    ends = np.cumsum(hi - lo + length) - 1                 # hi - lo + length - 1 bytes and a line feed each
    rows = np.searchsorted(b.ends, lo)
    text = b"\n".join(body[x:y + length - 1] for x, y in zip(lo.tolist(), hi.tolist(), strict=True))
    return pa.RecordBatch.from_pydict({
        "block": pa.array([number]), "n_suffixes": pa.array([int((hi - lo).sum())]), "ids": [b.ids[rows].tobytes()],
        "ends": [ends.astype(np.int64).tobytes()], "text": [zstandard.ZstdCompressor(level=1).compress(text)],
        "rows": [rows.astype(np.int64).tobytes()], "bases": [lo.astype(np.int64).tobytes()]})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (start, end of the maximal removed runs) and kept (the other bytes).

    ``length`` is 57 or more.  A byte goes if a string of ``length`` bytes over
    it also starts earlier: in a smaller id, or before in the same text.  Rows
    with the same id are separate texts, neither of them the earlier one.  Null
    and empty texts have no bytes; a null id comes after all others.  Without
    rows there is no result row.
    """
    if length < PERIOD:
        raise ValueError(f"length must be at least {PERIOD}")
    spark = docs.sparkSession
    blocks = text_blocks(docs, id_col, text_col)
    n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    n = B.bucket_count(n_bytes * len(COVER) / PERIOD, shuffle_partitions(spark))

    def ship_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, ends, text in B.rows_of(batches, "block", "ids", "ends", "text"):
            yield B.send(number, np.unique(B.bucket_keys(_samples(Block(ids, ends, text), length)[1], n)))

    def rank_samples(table: pa.Table) -> pa.Table:
        keys, ends = B.received(table)
        order = np.argsort(keys)
        s = keys[order]
        tie = np.zeros(len(s) + 1, bool)
        tie[1:-1] = s[1:] == s[:-1]
        out = np.zeros(len(s), np.uint8)
        out[order] = tie[1:] | tie[:-1]
        return B.answers(table, out, ends)

    ranks = kept(blocks.select("block", "ids", "ends", "text").mapInArrow(ship_samples, B.SENT)
                 .groupBy("bucket").applyInArrow(rank_samples, B.ANSWER), "cover-ranks")

    def find_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, ends, text, got in B.rows_of(batches, "block", "ids", "ends", "text", "got"):
            b = Block(ids, ends, text)
            lo, hi = _candidates(b, _repeated_samples(b, got, n, length), length)
            if len(lo):
                yield _region_rows(b, number, lo, hi, length)

    regions = kept(_with_answers(blocks, ranks).select("block", "ids", "ends", "text", "got").mapInArrow(find_regions, REGIONS), "regions")
    n_suffixes = regions.agg(F.coalesce(F.sum("n_suffixes"), F.lit(0)).alias("n")).first()["n"]
    m = B.bucket_count(n_suffixes, shuffle_partitions(spark))
    passes = max(1, math.ceil(n_suffixes * SUFFIX_BYTES / max(1, PASS_SHARE * n_bytes)))
    cuts = [round(m * k / passes) for k in range(passes + 1)]

    def sort_bucket(table: pa.Table) -> pa.Table:
        keys, ends = B.received(table)
        more = np.frombuffer(b"".join(table.column("extra").to_pylist()), _ENTRY)
        order = np.lexsort((more["id"], more["h2"], keys))
        k, h2, i = keys[order], more["h2"][order], more["id"][order]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (h2[1:] != h2[:-1])
        out = np.zeros(len(k), np.uint8)
        out[order] = i > i[first][np.cumsum(first) - 1]
        return B.answers(table, out, ends)

    def one_pass(low: int, high: int) -> DataFrame:
        def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, ids, ends, text, rows in B.rows_of(batches, "block", "ids", "ends", "text", "rows"):
                s = _Sorted(Block(ids, ends, text), np.frombuffer(rows, np.int64), m, low, high, length)
                yield B.send(number, *s.entries())
        sent = regions.select("block", "ids", "ends", "text", "rows").mapInArrow(ship, B.SENT)
        return kept(sent.groupBy("bucket").applyInArrow(sort_bucket, B.ANSWER), "suffix-ties")

    ties = reduce(DataFrame.unionByName, [one_pass(low, high) for low, high in zip(cuts[:-1], cuts[1:], strict=True)])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, ends, text, rows, bases, got in B.rows_of(batches, "block", "ids", "ends", "text", "rows", "bases", "got"):
            r, rows, bases = Block(ids, ends, text), np.frombuffer(rows, np.int64), np.frombuffer(bases, np.int64)
            here = _Sorted(r, rows, m, 0, m, length).repeated(got or [])
            region = np.searchsorted(r.ends, here)
            a, z = _runs(np.sort(bases[region] + here - r.starts[region]), length)
            yield pa.RecordBatch.from_pydict({"block": pa.array([number]), "a": [a.tobytes()], "z": [z.tobytes()]})

    spans = kept(_with_answers(regions, ties).select("block", "ids", "ends", "text", "rows", "bases", "got")
                 .mapInArrow(mark, "block long, a binary, z binary"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, text, a, z in B.rows_of(batches, "ids", "ends", "text", "a", "z"):
            yield _cut(Block(ids, ends, text), np.frombuffer(a or b"", np.int64), np.frombuffer(z or b"", np.int64))

    return blocks.join(spans, "block", "left").select("ids", "ends", "text", "a", "z").mapInArrow(cut, ROWS)


def _runs(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the strings of ``length`` bytes at ``at``; texts are a line feed apart."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > at[:-1] + length
    return at[new], at[np.concatenate([new[1:], [True]])] + length if len(at) else at


def _cut(b: Block, a: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    row = np.searchsorted(b.ends, a)
    edge = np.searchsorted(row, np.arange(len(b.ids) + 1))
    body, rest = b.text.tobytes(), []
    for i, (s, e) in enumerate(zip(b.starts.tolist(), b.ends.tolist(), strict=True)):
        parts, now = [], s
        for x, y in zip(a[edge[i]:edge[i + 1]].tolist(), z[edge[i]:edge[i + 1]].tolist(), strict=True):
            parts.append(body[now:x])
            now = y
        rest.append(b"".join([*parts, body[now:e]]))
    base = b.starts[row]
    spans = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array(a - base), pa.array(z - base)], names=["start", "end"]))
    return pa.RecordBatch.from_arrays([id_column(b.ids), pa.array(b.ends - b.starts), spans, pa.array(rest, pa.binary())],
                                      names=["doc_id", "n_bytes", "spans", "kept"])
