"""Exchange of block fingerprints by bucket.

A block ships each distinct 64-bit key once, as a bucket number and 48 more
bits; a bucket sees the keys of all blocks, sorts them and answers each block
with one small value per key, in the block's own order.  Keys never travel
with positions: the block finds them again from its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SENT = "bucket int, block long, keys binary, extra binary"
ANSWER = "block long, bucket int, bits binary"
_LOW = np.uint64((1 << 48) - 1)


def bucket_count(keys: float, partitions: int, each: int = 1_000_000) -> int:
    """Buckets of about ``each`` keys, but enough for every task to get some."""
    return int(min(65_536, max(4 * partitions, -(-keys // each))))


def bucket_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """bucket * 2^48 + low bits; ordering by it orders by bucket first."""
    b = ((hashes >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)
    return b << np.uint64(48) | hashes & _LOW


def send(block: int, keys: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows for the distinct, ascending ``keys`` of a block; ``extra`` has one item per key."""
    b = (keys >> np.uint64(48)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
    six = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays([
        pa.array(b[cut[:-1]].astype(np.int32) if len(b) else [], pa.int32()), pa.array([block] * len(pairs), pa.int64()),
        pa.array([six[a:z].tobytes() for a, z in pairs], pa.binary()),
        pa.array([None if extra is None else extra[a:z].tobytes() for a, z in pairs], pa.binary())],
        names=["bucket", "block", "keys", "extra"])


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of one bucket, row after row, and where each row's keys end."""
    blobs = table.column("keys").to_pylist()
    sizes = np.array([len(x) // 6 for x in blobs], np.int64)
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel(), np.cumsum(sizes)


def answers(table: pa.Table, values: np.ndarray, ends: np.ndarray) -> pa.Table:
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "bits": pa.array([values[a:z].tobytes() for a, z in zip(starts, ends.tolist(), strict=True)], pa.binary())})


def answered(keys: np.ndarray, bucket: list[int], bits: list[bytes], dtype) -> np.ndarray:
    """The answers to ``keys`` (ascending), put together from their buckets."""
    if not len(keys):
        return np.zeros(0, dtype)
    got = np.concatenate([np.frombuffer(x, dtype) for _, x in sorted(zip(bucket, bits, strict=True))])
    assert len(got) == len(keys), "a bucket's answer is missing"
    return got


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names], strict=True)
