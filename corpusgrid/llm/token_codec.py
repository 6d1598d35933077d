"""Token ids in files of independently reset, checksummed blocks under a context-mixing range coder.

An id is predicted by order 2 (what followed the last two ids), order 1 (what
followed the last id) and order 0 (the ids' shares in the frame, which its head
holds).  Order 1 and 2 keep a follower for each hashed context and count how
often it came true in a row; for each count, weights adapt to how often the
prediction holds.  The three are mixed into one probability, which an arithmetic
coder with a 56-bit range turns into 16-bit words.  Every block starts anew from
the frame's shares and empty contexts, so all blocks of a frame are coded side by
side, one numpy lane each, and a damaged block spoils no other.

Frame (one row of the dataset, little-endian): magic ``CGT3``; bytes and crc32 of
the head (2 x u32), which is: block size, number of documents, of blocks, of
distinct ids, bytes of the shares (5 x u32); the
shares (deflated: distinct ids as u32 steps, shares as u32, byte planes apart);
ids (i64) and lengths (u64) of the documents; per block its number of ids, of code
words and the crc32 of its ids (3 x u32).  Then the code words (u16) of all blocks.  A
frame holds whole documents.  Ids have up to 32 bits, at most ``MAX_DISTINCT`` of
them differ in one frame.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import gather, id_column, id_text, ready
from corpusgrid.llm.word_tokens import vocabulary_path, word_ids
from corpusgrid.session import checkpoint_root

MAGIC = b"CGT3"
BLOCK = 1024
FRAME_TOKENS = 2 << 20
#: Slots of the order-1 and order-2 tables of a block; both are powers of two.
SLOTS1, SLOTS2 = 512, 1024
#: Order-0 shares add up to this.
WHOLE = 1 << 20
MAX_DISTINCT = 1 << 19
#: Times in a row that a follower's count goes up to; a wrong prediction takes one off, at 0 the follower changes.
SURE = 3
#: In place of a count: no follower yet.
NONE = 4
_U = np.uint64
_ONE = _U(4096)
#: A lane whose range falls below the floor passes on the top word of its 56 bits.
_FLOOR, _KEEP = _U(1 << 40), _U((1 << 40) - 1)


class Shares:
    """Order 0: the distinct ids of a frame and their shares of ``WHOLE``, none below 1."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = ids, share
        self.cum = np.cumsum(share) - share

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Shares, np.ndarray]:
        """The shares of ``ids``, and each id's place among the distinct ones."""
        low, high = (int(ids.min()), int(ids.max())) if len(ids) else (0, 0)
        if 0 <= low and high < WHOLE:                      # vocabularies: a table by id
            table = np.bincount(ids.astype(np.int64))
            distinct = np.flatnonzero(table)
            count = table[distinct]
            table[distinct] = np.arange(len(distinct))
            place = table[ids]
        else:
            distinct, place, count = np.unique(ids, return_inverse=True, return_counts=True)
        if len(distinct) > MAX_DISTINCT or low < 0 or high >= 1 << 32:
            raise ValueError(f"ids of 32 bits, at most {MAX_DISTINCT} different ones, fit a frame")
        share = 1 + count * (WHOLE - len(distinct)) // max(1, len(ids))
        if len(share):
            share[share.argmax()] += WHOLE - share.sum()
        return cls(distinct.astype(np.int64), share.astype(np.int64)), place

    def packed(self) -> bytes:
        both = np.concatenate([np.diff(self.ids, prepend=0), self.share]).astype("<u4")
        return zlib.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes(), 6)

    @classmethod
    def unpacked(cls, n: int, data: bytes) -> Shares:
        planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
        both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        return cls(np.cumsum(both[:n]), both[n:])


class _Model:
    """The followers of both orders in many lanes, with their counts and the weights of each count, mixed; coder and
    decoder drive it alike.

    Each array has a row for order 1 and one for order 2, so that a step takes few calls.  The table is narrow, so that
    it stays in the cache; a step computes in 64 bits throughout, as numpy casts mixed widths through a buffer.
    """

    def __init__(self, lanes: int, shares: Shares):
        lane = np.arange(lanes, dtype=np.int64)
        self.one, self.two, self.slot = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros((2, lanes), np.int64)
        self.base = np.stack([lane * SLOTS1, lanes * SLOTS1 + lane * SLOTS2])
        # follower (place + 1) << 3 | count; NONE where there is none yet
        self.held = np.full(lanes * (SLOTS1 + SLOTS2), NONE, np.uint32)
        self.level0 = np.stack([lane, lanes + lane]) * (NONE + 1)
        # no follower weighs 1, which a wrong prediction leaves as it is
        self.odds = np.concatenate([np.tile([*(odds * np.arange(1, SURE + 2) // 2), 1], lanes) for odds in (400, 900)])

    def predict(self) -> None:
        # hashes of 32 bits; the slots are bits 16 to 24 and 3 to 12 of theirs
        k = self.one * 2654435761
        np.bitwise_and(k >> 16, SLOTS1 - 1, out=self.slot[0])
        k += self.two * 2246822519
        k &= 0xFFFFFFFF
        k ^= k >> 15
        np.bitwise_and(k >> 3, SLOTS2 - 1, out=self.slot[1])
        self.at = self.base + self.slot
        self.packed = self.held.take(self.at).astype(np.int64)
        self.says = self.packed >> 3
        self.sure = self.packed & 7
        self.level = self.level0 + self.sure
        self.weight = self.odds.take(self.level)
        self.p1, self.p2 = self.says
        w1, w2 = self.weight
        self.w12 = (w1 + w2).view(_U)
        # where both say the same, order 2 speaks for both
        self.w2 = (w2 + w1 * (self.p1 == self.p2)).view(_U)
        self.w1 = self.w12 - self.w2
        self.w0 = _ONE - self.w12

    def learn(self, stored: np.ndarray, right: np.ndarray) -> None:
        """Odds move a sixteenth of the way to 8 or 1,900 of 4,096 and never leave that span."""
        moved = np.where(right, 1900, 8)
        moved -= self.weight
        moved >>= 4
        moved += self.weight
        self.odds[self.level] = moved
        wrong = np.where((self.sure & SURE) > 0, self.packed - 1, stored << 3)
        self.held[self.at] = np.where(right, np.minimum(self.packed + 1, self.packed | SURE), wrong).astype(np.uint32)
        self.two, self.one = self.one, stored


def encode_lanes(places: np.ndarray, shares: Shares) -> tuple[np.ndarray, np.ndarray]:
    """Code words of full lanes (lanes x places among the distinct ids): (lanes x words, words used)."""
    lanes, n = places.shape
    m = _Model(lanes, shares)
    share0, cum0 = shares.share.astype(_U), shares.cum.astype(_U)
    low, span = np.zeros(lanes, _U), np.full(lanes, 1 << 56, _U)
    # word-major, since the lanes keep pace; flat[at] is the next word of each lane
    out = np.zeros((2 * n + 8, lanes), np.uint32)
    flat, every = out.ravel(), np.arange(lanes)
    at = every.copy()
    steps = np.ascontiguousarray(places.T)
    for k in range(n):
        x = steps[k]
        stored = x + 1
        m.predict()
        right = m.says == stored
        hit2 = right[1]
        hit1 = right[0] > hit2
        big2 = m.w2 << _U(20)
        cum = (m.w12 << _U(20)) + m.w0 * cum0.take(x)
        cum = np.where(hit2, _U(0), np.where(hit1, big2, cum))
        share = np.where(hit2, big2, np.where(hit1, m.w1 << _U(20), m.w0 * share0.take(x)))
        r = span >> _U(32)
        low += r * cum
        span = r * share
        need = span < _FLOOR
        flat[at] = (low >> _U(40)).astype(np.uint32)       # with the carry, settled below; stays where a word is due
        shift = need.astype(_U) << _U(4)
        low = np.where(need, low & _KEEP, low) << shift
        span <<= shift
        at += need * lanes
        more = np.flatnonzero(span < _FLOOR)
        while len(more):
            flat[at[more]] = low[more] >> _U(40)
            low[more] = (low[more] & _KEEP) << _U(16)
            span[more] <<= _U(16)
            at[more] += lanes
            more = more[span[more] < _FLOOR]
        m.learn(stored, right)
    for _ in range(4):
        flat[at] = low >> _U(40)
        low = (low & _KEEP) << _U(16)
        at += lanes
    used = at // lanes if lanes else at
    # what an unneeded store left behind a lane's end is no word of it
    out[np.arange(len(out))[:, None] >= used[None]] = 0
    carry = np.zeros(lanes, np.uint32)
    for k in range(int(used.max(initial=0)) - 1, -1, -1):
        out[k] += carry
        carry = out[k] >> np.uint32(16)
        out[k] &= np.uint32(0xFFFF)
    return np.ascontiguousarray(out.astype(np.uint16).T), used


def decode_lanes(words: np.ndarray, n: int, shares: Shares) -> np.ndarray:
    """The places (lanes x n) of code words (lanes x words, zero-padded)."""
    lanes = len(words)
    m = _Model(lanes, shares)
    share0, cum0 = shares.share.astype(_U), shares.cum.astype(_U)
    at0 = np.repeat(np.arange(len(shares.ids), dtype=np.uint32), shares.share)      # the place at each part of the whole
    words = np.concatenate([words.T, np.zeros((6, lanes), np.uint16)])
    flat, last = words.ravel(), words.size
    span = np.full(lanes, 1 << 56, _U)
    # the register has 56 bits: the first word's top byte pair sits at bit 40, the fourth word is split
    code = (words[0].astype(_U) << _U(40)) | (words[1].astype(_U) << _U(24)) | (words[2].astype(_U) << _U(8)) | (words[3].astype(_U) >> _U(8))
    tail = (words[3] & np.uint16(255)).astype(_U)
    at = np.arange(lanes) + 4 * lanes
    out = np.empty((n, lanes), np.uint32)
    for k in range(n):
        m.predict()
        r = span >> _U(32)
        v = np.minimum(code // r, _U((1 << 32) - 1))
        big2, big12 = m.w2 << _U(20), m.w12 << _U(20)
        hit2 = v < big2
        hit1 = (v < big12) > hit2
        # order 0 for all lanes; lanes with a hit wrap around to the last place and drop the result
        y = np.minimum((v - big12) // m.w0, _U(WHOLE - 1))
        x = at0.take(y.view(np.int64)).astype(np.int64)
        stored = np.where(hit2, m.p2, np.where(hit1, m.p1, x + 1))
        code -= r * np.where(hit2, _U(0), np.where(hit1, big2, big12 + m.w0 * cum0.take(x)))
        span = r * np.where(hit2, big2, np.where(hit1, m.w1 << _U(20), m.w0 * share0.take(x)))
        need = span < _FLOOR
        w = flat.take(at, mode="clip").astype(_U)
        code = np.where(need, (code << _U(16)) | (tail << _U(8)) | (w >> _U(8)), code)
        tail = np.where(need, w & _U(255), tail)
        span <<= need.astype(_U) << _U(4)
        at += need * lanes
        more = np.flatnonzero(span < _FLOOR)
        while len(more):
            w = flat[np.minimum(at[more], last - 1)].astype(_U)
            code[more] = (code[more] << _U(16)) | (tail[more] << _U(8)) | (w >> _U(8))
            tail[more] = w & _U(255)
            span[more] <<= _U(16)
            at[more] += lanes
            more = more[span[more] < _FLOOR]
        m.learn(stored, m.says == stored)
        out[k] = stored
    out -= np.uint32(1)
    return np.ascontiguousarray(out.T)


def write_frame(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    n_blocks = -(-len(ids) // block)
    shares, place = Shares.of(ids)
    padded = np.zeros(n_blocks * block, np.int64)
    padded[:len(ids)] = place
    size = np.full(n_blocks, block)
    if n_blocks:
        size[-1] = len(ids) - (n_blocks - 1) * block
    words, used = encode_lanes(padded.reshape(n_blocks, block), shares)
    raw, head = ids.astype("<u4"), shares.packed()
    crc = [zlib.crc32(raw[k * block:(k + 1) * block].tobytes()) for k in range(n_blocks)]
    heads = np.stack([size, used, np.array(crc, np.int64)], 1).astype("<u4") if n_blocks else np.zeros((0, 3), "<u4")
    front = b"".join([struct.pack("<5I", block, len(doc_ids), n_blocks, len(shares.ids), len(head)), head, doc_ids.astype("<i8").tobytes(),
                      lengths.astype("<u8").tobytes(), heads.tobytes()])
    return b"".join([MAGIC, struct.pack("<2I", len(front), zlib.crc32(front)), front,
                     words[np.arange(words.shape[1])[None] < used[:, None]].astype("<u2").tobytes()])


def read_frame(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a frame; raises ValueError on a foreign or damaged one."""
    if data[:4] != MAGIC:
        raise ValueError("not a token frame")
    n_front, crc = struct.unpack_from("<2I", data, 4)
    if zlib.crc32(data[12:12 + n_front]) != crc:
        raise ValueError("the frame's head fails its checksum")
    block, n_docs, n_blocks, n_ids, n_head = struct.unpack_from("<5I", data, 12)
    at = 32 + n_head
    shares = Shares.unpacked(n_ids, data[32:at])
    docs = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    heads = np.frombuffer(data, "<u4", 3 * n_blocks, at + 16 * n_docs).reshape(-1, 3)
    used = heads[:, 1].astype(np.int64)
    words = np.zeros((n_blocks, int(used.max(initial=0))), np.uint16)
    words[np.arange(words.shape[1])[None] < used[:, None]] = np.frombuffer(data, "<u2", int(used.sum()), at + 16 * n_docs + 12 * n_blocks)
    place = decode_lanes(words, block, shares) if n_blocks else np.zeros((0, block), np.uint32)
    ids = shares.ids[np.minimum(place[np.arange(block)[None] < heads[:, :1]], max(0, n_ids - 1))].astype("<u4")
    at = 0
    for k, (n, _, crc) in enumerate(heads.tolist()):
        if zlib.crc32(ids[at:at + n].tobytes()) != crc:
            raise ValueError(f"block {k} fails its checksum")
        at += n
    return docs, lengths, ids


FRAMES = "part int, seq int, n_tokens long, frame binary"


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 end_id: int = 2) -> None:
    """Write the ids of all texts, each with ``end_id``, in ascending id order (null last) as a dataset of frames.

    Null and empty texts are the end id alone; rows that repeat an id follow one
    another; an empty table gives an empty dataset.
    """
    ready(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part = word_ids(vocabulary), TaskContext.get().partitionId()
        seq, held = 0, []

        def row():
            doc, length, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
                pa.array([write_frame(doc, length, ids)], pa.binary())], names=["part", "seq", "n_tokens", "frame"])

        for doc, ends, body in gather(batches):
            ids, at = encoder.encode(ends, body, end_id)
            held.append((doc, np.diff(at), ids))
            if sum(len(x[2]) for x in held) >= FRAME_TOKENS:
                yield row()
                seq, held = seq + 1, []
        if held:
            yield row()

    ordered = id_text(docs, id_col, text_col).repartitionByRange(F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last())
    ordered.mapInArrow(run, FRAMES).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and ids (unsigned
    32-bit little-endian)."""
    ready(spark)
    frames = spark.read.schema(FRAMES).parquet(path)
    # one row per written part, then the frames of each part
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = (frames.select("part", "seq", "n_tokens").withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(parts, "part").select("part", "seq", (F.col("base") + F.col("ahead")).alias("base")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column("base").to_pylist(), b.column("frame").to_pylist(), strict=True):
                doc, length, ids = read_frame(data)
                raw = memoryview(ids.tobytes())
                at = np.concatenate([[0], np.cumsum(length)])
                for lo in range(0, len(doc), 2000):
                    hi = min(len(doc), lo + 2000)
                    yield pa.RecordBatch.from_arrays([
                        id_column(doc[lo:hi].astype(np.int64)), pa.array(first + at[lo:hi]), pa.array(length[lo:hi]),
                        pa.array([bytes(raw[4 * a:4 * z]) for a, z in zip(at[lo:hi].tolist(), at[lo + 1:hi + 1].tolist(), strict=True)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    # one small row per frame (millions of ids each): the frames stay where they are while the size allows it
    return (frames.join(base, ["part", "seq"]).select("base", "frame")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))


def files_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"

