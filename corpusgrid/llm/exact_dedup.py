"""Exact dedup with Patricia tries that hold the owner of every distinct text.

Texts are cut down to their bytes without white space.  Each task first folds
the copies it holds itself, so that a text which a third of all rows share
travels once per task.  Partitions by (length, content hash) then insert the
full byte strings into a compressed radix trie whose terminal nodes keep the
owner; as the rows arrive in (length, hash) order, a finished subtree is
written out and freed before the next one starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.common import SPACE_CHARS, id_array, id_column, id_text, kept, ready, text_bytes

FOLD_BYTES = 16 << 20
_DELETE = SPACE_CHARS.encode()
FOLDED = "doc_id long, n_points long, n_bytes long, sha string, body binary, own_points long, own_id long, copies long"
OWNERS = "n_bytes long, sha string, keep_points long, keep_id long, group_size long"


class Patricia:
    """Compressed radix trie of byte strings; a terminal holds [(-points, id) of the owner, copies]."""

    __slots__ = ("root", "size")

    def __init__(self):
        self.root: list = [b"", {}, None]     # edge label, children by first byte, terminal
        self.size = 0

    def insert(self, key: bytes, owner: tuple[int, int], copies: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[2] is None:
                    node[2] = [owner, 0]
                node[2][0] = min(node[2][0], owner)
                node[2][1] += copies
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [owner, copies]]
                self.size += len(key) - at
                return
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same = _common(edge, key[at:at + len(edge)])
            node[1][key[at]] = [edge[:same], {edge[same]: child}, None]       # split the edge
            child[0] = edge[same:]
            node, at = node[1][key[at]], at + same

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) if differ.any() else n


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; the first holder of a text in this window also carries its bytes and owner."""
    rows: list[list] = []
    first: dict[str, int] = {}
    held = 0

    def out():
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([
            id_column(np.array(cols[0], np.int64)), *(pa.array(cols[i], pa.int64()) for i in (1, 2)), pa.array(cols[3], pa.string()),
            pa.array(cols[4], pa.binary()), *(pa.array(cols[i], pa.int64()) for i in (5, 6, 7))],
            names=[x.split()[0] for x in FOLDED.split(", ")])

    for batch in batches:
        points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
        for i, n, x in zip(id_array(batch.column(0)).tolist(), points, text_bytes(batch.column(1)), strict=True):
            body = x.translate(None, _DELETE)
            sha = hashlib.sha256(body).hexdigest()
            if sha in first and rows[first[sha]][4] == body:
                r = rows[first[sha]]
                r[5], r[6] = min((r[5], r[6]), (-n, i))
                r[7] += 1
                rows.append([i, n, len(body), sha, None, None, None, None])
            else:
                first[sha] = len(rows)
                rows.append([i, n, len(body), sha, body, -n, i, 1])
                held += len(body)
            if held >= FOLD_BYTES:
                yield out()
                rows, first, held = [], {}, 0
    if rows:
        yield out()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, now, done = Patricia(), None, []

    def out():
        cols = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *(
            pa.array(c, pa.int64()) for c in cols[2:])], names=[x.split()[0] for x in OWNERS.split(", ")])

    def spill():
        done.extend((*now, -t[0][0], t[0][1], t[1]) for t in trie.terminals())

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("n_bytes", "sha", "body", "own_points", "own_id", "copies")]
        for n, sha, body, points, own, copies in zip(*cols, strict=True):
            if now is not None and now != (n, sha):       # rows come sorted: that subtree is finished
                spill()
                trie = Patricia()
            now = (n, sha)
            trie.insert(body, (points, own), copies)
            if len(done) >= 10_000:
                yield out()
                done = []
    if now is not None:
        spill()
    if done:
        yield out()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_sha256 (bytes without white space), keep_id, group_size and kept.

    The row with the most code points stays, then the smallest id.  Null texts
    are empty, all empty texts are one group.  A null id comes after all others.
    Rows that repeat the kept id and text are all marked kept.
    """
    ready(docs.sparkSession)
    folded = kept(id_text(docs, id_col, text_col).mapInArrow(_fold, FOLDED), "folded")
    owners = (folded.where(F.col("body").isNotNull()).select("n_bytes", "sha", "body", "own_points", "own_id", "copies")
              .repartition("n_bytes", "sha").sortWithinPartitions("n_bytes", "sha").mapInArrow(_own, OWNERS))
    owners = owners.select(F.col("sha").alias("text_sha256"), "keep_points", "keep_id", "group_size")
    rows = folded.select("doc_id", "n_points", F.col("sha").alias("text_sha256"))
    last = F.lit(int(np.iinfo(np.int64).max))
    return (rows.join(owners, "text_sha256")
            .withColumn("kept", (F.coalesce("doc_id", last) == F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))
            .withColumn("keep_id", F.nullif("keep_id", last))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
