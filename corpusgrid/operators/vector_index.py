"""W22 with a stored index: inverted cells, multi-probe search, residual bounds.

``build_index`` writes the unit vectors of a corpus by cell, next to a small table
of the cells: pivot, rows, radius.  The pivots are the centres of a k-means fit on
a bounded sample; every row is indexed, in the cell of its nearest pivot, with its
distance to it (the residual).  Rows lie sorted by cell, so that a reader of a few
cells skips the other row groups.  An index is a committed dataset
(``sources.store.commit``): readers see a whole version or the one before.

``search_index`` sends each query to the ``probes`` nearest cells, and to more of
them where those hold fewer than k rows.  A cell whose residuals prove that it
cannot hold one of the k nearest rows is left out.  ``probes=None`` visits every
cell that the bounds leave, so the answer is exact.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.functions.arrays import with_unit_vector
from corpusgrid.operators.vectors import MAX_BLOCK_VALUES, VISITED, assign_cells, cell_slots, match_slots, slot_places, visited_slots
from corpusgrid.session import materialize
from corpusgrid.sources import store

#: Most cells (each task holds their pivots) and rows of the fit sample for each of them.
MAX_PIVOTS, SAMPLE_ROWS = 16_384, 64
#: Most distinct cells of a batch of queries whose row groups are picked by name; beyond, all are read.
PICKED_CELLS = 2_000


@dataclasses.dataclass
class VectorIndex:
    """An opened version of an index: its rows (cell, id, u, dist) and, for each cell, pivot, rows and radius."""

    rows: DataFrame
    id_type: str
    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    version: int


def build_index(corpus: DataFrame, path: str, id_col: str = "doc_id", vec_col: str = "embedding", cells: int | None = None,
                seed: int = 42) -> VectorIndex:
    """Index the unit vectors of ``corpus`` under ``path`` as a new version; zero and null vectors are left out.

    ``cells`` is about the square root of the number of rows unless set.
    """
    spark = corpus.sparkSession
    unit = (with_unit_vector(corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")), "_v", "u", drop_zero=True)
            .select("id", "u"))
    unit = materialize(unit, "index_vectors")          # counted, sampled and assigned
    n = unit.count()
    cells = max(1, min(MAX_PIVOTS, n, cells or math.isqrt(n)))
    id_type = unit.schema["id"].dataType.simpleString()
    if n:
        sample = unit.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells * SAMPLE_ROWS)
        sample = sample.repartition(spark.sparkContext.defaultParallelism)      # a limit leaves one partition
        fit = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(sample.select(array_to_vector("u").alias("f")))
        pivots = np.array(fit.clusterCenters(), np.float64)
    else:
        pivots = np.zeros((0, 0))
    bp = spark.sparkContext.broadcast(pivots)          # at most MAX_PIVOTS rows
    rows = unit.withColumnRenamed("id", "cid").mapInArrow(assign_cells(bp), f"cid {id_type}, u array<double>, cell int, dist double")
    rows = rows.withColumnRenamed("cid", "id")
    at = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "cell int, pivot array<double>")

    def write(folder: str) -> None:
        # ids break the ties of a cell that holds a third of the rows, so that it spreads over partitions
        rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{folder}/rows")
        held = spark.read.parquet(f"{folder}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"))
        at.join(held, "cell").write.parquet(f"{folder}/cells")

    version = store.commit(spark, path, write, {"rows": n, "cells": cells})
    return open_index(spark, path, version)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
    """The current (or a given) version of the index at ``path``."""
    folder, version, _ = store.committed(spark, path, version)
    rows = spark.read.parquet(f"{folder}/rows")
    cells = sorted(spark.read.parquet(f"{folder}/cells").collect(), key=lambda r: r["cell"])   # at most MAX_PIVOTS rows
    size = 1 + max((r["cell"] for r in cells), default=-1)
    count, radius = np.zeros(size, np.int64), np.zeros(size)
    pivots = np.full((size, len(cells[0]["pivot"]) if cells else 0), 1e3)      # an empty cell is far from every query
    for r in cells:
        pivots[r["cell"]], count[r["cell"]], radius[r["cell"]] = r["pivot"], r["n"], r["radius"]
    return VectorIndex(rows, rows.schema["id"].dataType.simpleString(), pivots, count, radius, version)


def search_index(queries: DataFrame, index: VectorIndex, k: int = 10, probes: int | None = 8, query_id: str = "query_id",
                 query_vec: str = "embedding", block_size: int = 65536, digits: int = 6) -> DataFrame:
    """(query_id, rank, neighbor_id, similarity): the k most similar rows of the visited cells, ties by the smaller id."""
    spark = queries.sparkSession
    asked = (with_unit_vector(queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_v")), "_v", "u", drop_zero=True)
             .select("query_id", "u"))
    qtype = asked.schema["query_id"].dataType.simpleString()
    if not len(index.pivots):
        return spark.createDataFrame([], f"query_id {qtype}, rank int, neighbor_id {index.id_type}, similarity double")
    block = max(1, min(block_size, MAX_BLOCK_VALUES // index.pivots.shape[1]))
    base, share = cell_slots(index.count, block)
    bc = spark.sparkContext.broadcast((index.pivots, index.count, index.radius, base, share))
    sent = asked.mapInArrow(visited_slots(bc, k, digits, probes), f"query_id {qtype}, u array<double>, {VISITED}")
    # a query is stored once, and sent once for each slot, not for each cell
    sent = materialize(sent, "index_queries")
    visited = [r["cell"] for r in sent.select(F.explode("seen").alias("cell")).distinct().collect()]    # at most MAX_PIVOTS rows
    rows = index.rows.where(F.col("cell").isin(visited)) if len(visited) <= min(PICKED_CELLS, len(share) - 1) else index.rows
    # the table of cells has at most MAX_PIVOTS rows
    place = slot_places(base, share)[0]
    table = F.broadcast(spark.createDataFrame([(c, int(base[c]), int(share[c]), int(place[c])) for c in visited], "cell int, base int, share int, place int"))
    rows = (rows.join(table, "cell")
            .select(F.col("id").alias("cid"), "u", F.col("place").alias("cell"), (F.col("base") + F.pmod(F.xxhash64("id"), F.col("share"))).cast("int").alias("_slot")))
    return match_slots(sent, rows, k, digits, block)


def choose_probes(index: VectorIndex, k: int = 10, target: float = 0.95, sample: int = 256) -> int:
    """The fewest probes with which a sample of the index' own rows finds the share ``target`` of its exact neighbours.

    The sample (by hash of the id) is answered exactly; then the place of each
    neighbour's cell in its query's order of cells tells how many probes reach it.
    """
    if not len(index.pivots):
        return 1
    asked = materialize(index.rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), F.col("u").alias("embedding")), "index_sample")
    exact = search_index(asked, index, k, probes=None)
    at = exact.join(index.rows.select(F.col("id").alias("neighbor_id"), "cell"), "neighbor_id").select("query_id", "cell").collect()  # sample * k rows
    vectors = {r["query_id"]: np.array(r["embedding"]) for r in asked.collect()}
    place = {q: np.argsort(np.argsort(np.linalg.norm(index.pivots - u, axis=1), kind="stable"), kind="stable") for q, u in vectors.items()}
    need = sorted(int(place[r["query_id"]][r["cell"]]) + 1 for r in at)
    return need[min(len(need) - 1, math.ceil(target * len(need)) - 1)] if need else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_queries, n_exact, n_found, recall): the share of the exact neighbours that were found."""
    pair = ["query_id", "neighbor_id"]
    both = exact.select(*pair, F.lit(1).alias("e")).join(found.select(*pair, F.lit(1).alias("f")), pair, "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.count("f").alias("n_found"),
                    (F.count("f") / F.count("*")).alias("recall"))
