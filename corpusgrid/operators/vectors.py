"""W21 unit vectors and W22 exact nearest neighbours (cosine top-k).

Plan for W22; neither side passes through the driver and the queries x corpus
matrix is never materialised:

* both sides are unit-normalised with JVM array expressions; zero vectors
  become null and never match (nor ask);
* the corpus falls into cells around at most ``MAX_CELLS`` of its own rows (a
  bounded set of pivots); a cell is known by its row count and radius.  A query
  visits the cells that can hold one of its k nearest rows by the triangle
  inequality, so the answer is exact whatever the pivots are;
* small cells share a slot of about ``block_size`` rows and a large cell is cut
  into several, so a query is sent once for each slot with a bit for each cell
  there, however many cells there are, and is stored once with its slots and bits;
  the queries of a slot are cut into slices
  of as many, so that a hot cell or a vector held by a third of the rows spreads
  over tasks; slot and slice meet in a cogroup that multiplies chunk by chunk and
  keeps exactly k rows per query by (rounded similarity, id);
* a final ``row_number`` per query runs over at most visited slots x k candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.functions.arrays import with_unit_vector
from corpusgrid.session import materialize

CHUNK_ROWS = 2048          # corpus rows per matrix product
CHUNK_QUERIES = 512        # queries per matrix product
CHUNK_DISTANCES = 500_000  # queries x cells whose distances are held at once
SLICES_A_CORE = 3          # slices of queries for each core, while a slice has at least LEAST_QUERIES
LEAST_QUERIES = 1024
MAX_BLOCK_VALUES = 4_000_000    # one side of a cogroup: rows x dim doubles (32 MB)
MAX_CELLS = 256            # pivots that the driver and each task hold
CELL_ROWS = 8192           # corpus rows per cell while there are fewer than MAX_CELLS cells


def unit_vectors(df: DataFrame, vec_col: str = "embedding", out_col: str = "unit") -> DataFrame:
    """Add ``out_col`` = vec / ||vec|| (array<double>); zero vectors -> null."""
    return with_unit_vector(df, vec_col, out_col)


def _matrix(column) -> np.ndarray:
    """Rows of a non-empty list column as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks])
    return flat.astype(np.float64, copy=False).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))


def assign_cells(bp):
    """Corpus rows with the nearest pivot and the distance to it."""
    def run(batches):
        step = max(1, CHUNK_DISTANCES // max(1, len(bp.value)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rb = batch.slice(at, step)
                d = _distances(_matrix(rb.column("u")), bp.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [rb.column("cid"), rb.column("u"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                    names=["cid", "u", "cell", "dist"])
    return run


def cell_slots(count: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, share): a cell's rows lie in slots base .. base + share - 1; cells that fit one block together share a slot."""
    base, share = np.zeros(len(count), np.int64), np.ones(len(count), np.int64)
    slot, room = -1, 0
    for c, n in enumerate(count.tolist()):
        if n > block:
            base[c], share[c] = slot + 1, -(-n // block)
            slot, room = slot + int(share[c]), 0
        else:
            if n > room or slot < 0:
                slot, room = slot + 1, block
            base[c], room = slot, room - n
    return base, share


def slot_places(base: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, at, width): a cell's place among the cells of its slot, for each slot of a cell where its bit lies in a
    row of all slots' bits, and the bytes of each slot (each starts a byte of its own)."""
    slot = np.repeat(base - (np.cumsum(share) - share), share) + np.arange(share.sum())      # ascending
    place = np.arange(len(slot)) - np.searchsorted(slot, slot)
    width = -(-np.bincount(slot) // 8)
    return place[np.cumsum(share) - share], place + 8 * (np.cumsum(width) - width)[slot], width


def visited_slots(bc, k: int, digits: int, probes: int | None = None):
    """Queries with the slots, and a bit for each cell there, that can hold one of their k nearest rows; with ``probes``,
    only the nearest so many cells, and further ones until they hold k rows.  ``seen``: the visited cells, each once in a task."""
    def run(batches):
        pivots, count, radius, base, share = bc.value
        _, at_bit, width = slot_places(base, share)
        of_bit, starts = np.repeat(np.arange(len(share)), share), np.cumsum(width) - width
        step, told = max(1, CHUNK_DISTANCES // max(1, len(pivots))), np.zeros(len(pivots), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rb = batch.slice(at, step)
                n = rb.num_rows
                d = _distances(_matrix(rb.column("u")), pivots)
                reach = d + radius
                order = np.argsort(reach, axis=1)
                enough = np.cumsum(count[order], axis=1) >= k
                last = np.where(enough.any(axis=1), enough.argmax(axis=1), reach.shape[1] - 1)
                # k rows lie within this distance; equal rounded similarities and float error get their room
                bound = reach[np.arange(n), order[np.arange(n), last]]
                within = np.maximum(d - radius - 1e-6, 0) ** 2 <= ((bound + 1e-6) ** 2)[:, None] + 4 * 10.0 ** -digits
                within &= count > 0
                if probes is not None:
                    by_distance = np.argsort(d, axis=1, kind="stable")
                    held = np.cumsum(count[by_distance], axis=1)
                    most = np.maximum(probes, 1 + (held < k).sum(axis=1))
                    within &= np.argsort(by_distance, axis=1) < most[:, None]                # place of each cell by distance
                bits = np.zeros((n, 8 * int(width.sum())), bool)
                bits[:, at_bit] = within[:, of_bit]
                bits = np.packbits(bits, axis=1, bitorder="little")
                some = np.logical_or.reduceat(bits > 0, starts, axis=1)
                slot = np.nonzero(some)[1]
                ends = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
                edges = np.concatenate([[0], np.cumsum(width[slot])]).astype(np.int32)
                sent = bits[np.repeat(some, width, axis=1)]                                  # by query, then by slot
                cells = pa.BinaryArray.from_buffers(pa.binary(), len(slot), [None, pa.py_buffer(edges), pa.py_buffer(sent)])
                new = np.flatnonzero(within.any(axis=0) & ~told)
                told[new] = True
                seen = pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(n, len(new))].astype(np.int32)), pa.array(new.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [rb.column("query_id"), rb.column("u"), pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), cells), seen],
                    names=["query_id", "u", "slots", "cells", "seen"])
    return run


#: What ``visited_slots`` adds to a query's id and vector.
VISITED = "slots array<int>, cells array<binary>, seen array<int>"


def best_rows(k: int, digits: int):
    """Exactly k rows per query of one slice and one slot, by (rounded similarity, smaller id), from the cells it visits.
    ``cell`` of a row is its cell's place in the slot, the bit of the queries' ``cells``."""
    scale = 10 ** digits
    none = np.iinfo(np.int64).min

    def rounded(sims):
        out = np.abs(sims)
        out *= scale
        out += 0.5
        return np.copysign(np.floor(out, out=out), sims, out=out).astype(np.int64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "neighbor_id": right.column("cid").slice(0, 0),
                             "similarity": pa.array([], pa.float64())})
        q, x = _matrix(left.column("u")), _matrix(right.column("u"))
        n = len(x)
        by_id = pc.sort_indices(right.column("cid")).to_numpy()
        rank = np.empty(n, np.int64)
        rank[by_id] = np.arange(n)
        # the rows of each cell, and the queries that visit it
        cell = right.column("cell").to_numpy()
        by_cell = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(cell[by_cell]) != 0, True])
        bits = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(len(q), -1)
        held = np.full((len(q), k), none)
        floor = np.full(len(q), -np.inf)               # what lies below cannot be among a query's k best any more
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            place = int(cell[by_cell[lo]])
            visitors = np.flatnonzero(bits[:, place >> 3] & (1 << (place & 7)))
            for q0 in range(0, len(visitors), CHUNK_QUERIES):
                part = visitors[q0:q0 + CHUNK_QUERIES]
                for r0 in range(lo, hi, CHUNK_ROWS):
                    rows = by_cell[r0:min(hi, r0 + CHUNK_ROWS)]
                    sims = q[part] @ x[rows].T
                    a, b = np.nonzero(sims >= floor[part, None])
                    if not len(a):
                        continue
                    # one number orders by rounded similarity, then by smaller id
                    if len(a) > 8 * k * len(part):
                        both = np.concatenate([held[part], rounded(sims) * n + (n - 1 - rank[rows])], axis=1)
                        held[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    else:
                        key = np.concatenate([held[part].ravel(), rounded(sims[a, b]) * n + (n - 1 - rank[rows[b]])])
                        of = np.concatenate([np.repeat(np.arange(len(part)), k), a])
                        order = np.lexsort((key, of))
                        last = np.cumsum(np.bincount(of, minlength=len(part)))
                        held[part] = key[order][last[:, None] - np.arange(1, k + 1)]
                    least = held[part].min(axis=1)
                    floor[part] = np.where(least == none, -np.inf, (least // n - 1) / scale)
        at, _ = np.nonzero(held > none)
        key = held[held > none]
        value = key // n
        return pa.table({"query_id": left.column("query_id").take(pa.array(at)),
                         "neighbor_id": right.column("cid").take(pa.array(by_id[n - 1 - (key - value * n)])),
                         "similarity": pa.array(value / scale)})
    return run


def match_slots(sent: DataFrame, rows: DataFrame, k: int, digits: int, block: int) -> DataFrame:
    """(query_id, rank, neighbor_id, similarity) of queries (query_id, u, slots, cells), stored, and rows (cid, u, cell, _slot).

    A query's vector is stored once and multiplied only on its way to the slots.  The queries of a slot are cut into slices; the slot's rows meet only the slices that visit it."""
    types = {f.name: f.dataType.simpleString() for f in (*sent.schema, *rows.schema)}
    # few slots of many queries still make work for every core; one row for each slot
    asked = sent.select(F.explode("slots").alias("_slot"))
    sent = (sent.select("query_id", "u", F.explode(F.arrays_zip("slots", "cells")).alias("at"))
            .select("query_id", "u", F.col("at.slots").alias("_slot"), F.col("at.cells").alias("cells")))
    cores, slots = sent.sparkSession.sparkContext.defaultParallelism, asked.agg(F.count_distinct("_slot")).first()[0]
    most = F.least(F.lit(-(-SLICES_A_CORE * cores // max(1, slots))), F.ceil(F.count("*") / F.lit(LEAST_QUERIES)))
    per_slot = asked.groupBy("_slot").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), most).cast("int").alias("slices"))
    sent = sent.join(F.broadcast(per_slot), "_slot").withColumn("_slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int"))
    rows = rows.join(F.broadcast(per_slot), "_slot").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    found = (sent.select("query_id", "u", "cells", "_slot", "_slice").groupBy("_slot", "_slice")
             .cogroup(rows.select("cid", "u", "cell", F.col("_slot").alias("_row_slot"), F.col("_slice").alias("_row_slice"))
                      .groupBy("_row_slot", "_row_slice"))
             .applyInArrow(best_rows(k, digits), f"query_id {types['query_id']}, neighbor_id {types['cid']}, similarity double"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("neighbor_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "neighbor_id", "similarity"))


def nearest_neighbors(queries: DataFrame, corpus: DataFrame, k: int = 10, query_id: str = "query_id",
                      corpus_id: str = "doc_id", query_vec: str = "embedding", corpus_vec: str = "embedding",
                      block_size: int = 65536, digits: int = 6, cells: int | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, similarity) with rank 1 = most similar.

    Ids may be of any type that orders.  Fewer than k corpus rows -> all of them.
    ``similarity`` is rounded to ``digits`` places and ties are broken by the
    smaller id.  ``cells`` sets the number of pivots (else by the corpus' size);
    neither it nor ``block_size`` changes the result.
    """
    spark = queries.sparkSession
    qn = (with_unit_vector(queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_v")),
                           "_v", "u", drop_zero=True).select("query_id", "u"))
    cn = (with_unit_vector(corpus.select(F.col(corpus_id).alias("cid"), F.col(corpus_vec).alias("_v")),
                           "_v", "u", drop_zero=True).select("cid", "u"))
    qtype, ctype = (f.schema[c].dataType.simpleString() for f, c in ((qn, "query_id"), (cn, "cid")))
    sizes = cn.agg(F.count("*").alias("n"), F.max(F.size("u")).alias("dim")).first()
    n, asked = sizes["n"], qn.count()
    if not n or not asked:
        return spark.createDataFrame([], f"query_id {qtype}, rank int, neighbor_id {ctype}, similarity double")
    block = max(1, min(block_size, MAX_BLOCK_VALUES // sizes["dim"]))
    cells = min(MAX_CELLS, cells or max(1, n // CELL_ROWS))
    if cells == 1:
        # one cell: every query visits all of its slots
        slots = math.ceil(n / block)
        cn = cn.select("cid", "u", F.lit(0).alias("cell"), F.pmod(F.xxhash64("cid"), F.lit(slots)).cast("int").alias("_slot"))
        qn = qn.select("query_id", "u", F.sequence(F.lit(0), F.lit(slots - 1)).alias("slots"), F.array_repeat(F.lit(b"\x01"), slots).alias("cells"))
    else:
        # at most MAX_CELLS rows reach the driver, whatever the corpus' size
        pivots = np.array([r["u"] for r in cn.orderBy(F.xxhash64("cid"), "cid").limit(cells).collect()], np.float64)
        bp = spark.sparkContext.broadcast(pivots)
        cn = materialize(cn.mapInArrow(assign_cells(bp), f"cid {ctype}, u array<double>, cell int, dist double"), "corpus_cells")
        known = {r["cell"]: r for r in cn.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}
        count = np.array([known[c]["n"] if c in known else 0 for c in range(len(pivots))], np.int64)
        radius = np.array([known[c]["radius"] if c in known else 0.0 for c in range(len(pivots))])
        base, share = cell_slots(count, block)
        of = lambda v: F.element_at(F.array(*[F.lit(int(x)) for x in v]), F.col("cell") + 1)
        cn = cn.select("cid", "u", of(slot_places(base, share)[0]).alias("cell"),
                       (of(base) + F.pmod(F.xxhash64("cid"), of(share))).cast("int").alias("_slot"))
        bc = spark.sparkContext.broadcast((pivots, count, radius, base, share))
        qn = (qn.mapInArrow(visited_slots(bc, k, digits), f"query_id {qtype}, u array<double>, {VISITED}")
              .select("query_id", "u", "slots", "cells"))
    return match_slots(materialize(qn, "queries_sent"), cn, k, digits, block)
