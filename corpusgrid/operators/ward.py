"""W27 bottom-up: Ward clustering of all rows by contracting a nearest-neighbour graph.

Every row starts as a cluster (weight, sum of its vectors).  Edges join each
cluster to its ``neighbors`` nearest centroids (W22, exact); an edge's cost is the
growth of the squared error that merging its ends would bring.  In a round every
cluster picks its cheapest edge; edges picked from both ends are merged, all of
them at once (Ward's costs never fall by merging others, so that is the order of
the greedy tree).  The cheapest edge of all is always among them, so a round
never ends empty.  Merged ends take over each other's edges.  When no edge is
left between several clusters, a new graph joins their centroids.

All of it is joins and aggregates: a merge is a row of the log, a round writes
three tables, and counts are all that reaches the driver.  A constant share of
the clusters goes in a round, so the rounds grow with the logarithm of the rows.
Once at most ``LAST_CLUSTERS`` are left, whatever the rows were, one task does the
rounds of their graph (``last_rounds``): many rounds of few merges each.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.operators.ranking import global_rank
from corpusgrid.operators.vectors import nearest_neighbors
from corpusgrid.session import materialize

MERGES = "round int, left long, right long, n_left long, n_right long, cost double, height double"
#: Clusters whose rounds one task does; their graph has at most half as many edges as their square.
LAST_CLUSTERS = 1024
#: Numbers in all clusters' sums up to which every task gets the clusters, so that edges are priced where they lie (16 MB).
BROADCAST_VALUES = 2_000_000


def merge_cost(w1: Column, s1: Column, w2: Column, s2: Column) -> Column:
    """Growth of the squared error when clusters of w rows with sum s become one."""
    apart = F.aggregate(F.zip_with(s1, s2, lambda x, y: x / w1 - y / w2), F.lit(0.0), lambda a, d: a + d * d)
    return w1 * w2 / (w1 + w2) * apart


def _graph(clusters: DataFrame, neighbors: int) -> DataFrame:
    """(a, b), a < b: every cluster with its nearest centroids by Euclidean distance.

    Distances become angles: (c, -|c|^2 / 2, rest) has one length for all c when
    rest fills it up, and its product with (q, 1, 0) orders c as the distance to q does.
    """
    c = clusters.select("id", F.transform("s", lambda x: x / F.col("w")).alias("c"))
    c = c.withColumn("half", F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x / 2))
    length = c.agg(F.max(2 * F.col("half") + F.col("half") * F.col("half"))).first()[0] or 1.0
    rest = F.sqrt(F.greatest(F.lit(length) - 2 * F.col("half") - F.col("half") * F.col("half"), F.lit(0.0)))
    corpus = c.select("id", F.concat("c", F.array(-F.col("half"), rest)).alias("v"))
    asked = c.select("id", F.concat("c", F.array(F.lit(1.0), F.lit(0.0))).alias("v"))
    near = nearest_neighbors(asked, corpus, k=neighbors + 1, query_id="id", corpus_id="id", query_vec="v", corpus_vec="v", digits=9)
    return (near.where("query_id <> neighbor_id")
            .select(F.least("query_id", "neighbor_id").alias("a"), F.greatest("query_id", "neighbor_id").alias("b")).distinct())


def _priced(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    a = clusters.select(F.col("id").alias("a"), F.col("w").alias("wa"), F.col("s").alias("sa"))
    b = clusters.select(F.col("id").alias("b"), F.col("w").alias("wb"), F.col("s").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", merge_cost(F.col("wa"), F.col("sa"), F.col("wb"), F.col("sb")).alias("cost"))


def _sent(clusters: DataFrame, n: int, dim: int) -> DataFrame:
    """The clusters, sent to every task while their n sums are few numbers."""
    return F.broadcast(clusters) if n * dim <= BROADCAST_VALUES else clusters


def _cheapest_of_both(edges: DataFrame) -> DataFrame:
    """Edges that are the cheapest of both their ends; the order (cost, a, b) has no ties."""
    key = F.struct("cost", "a", "b")
    ends = edges.select(F.explode(F.array("a", "b")).alias("end"), key.alias("e"))
    picked = ends.groupBy("end").agg(F.min("e").alias("e"))
    return picked.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.*")


def last_rounds(done: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rounds after round ``done`` of a bounded graph, until no edge is left: its merges (s null), then the clusters that
    remain (round null, id, w and h in left, n_left and height)."""
    def run(clusters: pa.Table, edges: pa.Table) -> pa.Table:
        ids = clusters.column("id").to_numpy()
        order = np.argsort(ids)
        ids, w, h = ids[order], clusters.column("w").to_numpy()[order], clusters.column("h").to_numpy()[order]
        s = np.array(clusters.column("s").to_pylist(), np.float64)[order]

        def priced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            apart = np.zeros(len(a))
            for x in s.T:                                  # one dimension after the other, as ``merge_cost`` adds them
                apart += (x[a] / w[a] - x[b] / w[b]) ** 2
            return w[a] * w[b] / (w[a] + w[b]) * apart

        a, b = (np.searchsorted(ids, edges.column(c).to_numpy()) for c in ("a", "b"))
        cost, k, live, log = edges.column("cost").to_numpy(), done, np.ones(len(ids), bool), []
        while len(a):
            k += 1
            rank = np.empty(len(a), np.int64)
            rank[np.lexsort((b, a, cost))] = np.arange(len(a))
            first = np.full(len(ids), len(a))
            np.minimum.at(first, a, rank)
            np.minimum.at(first, b, rank)
            both = np.flatnonzero((first[a] == rank) & (first[b] == rank))
            left, right = a[both], b[both]
            height = np.maximum(cost[both], np.maximum(h[left], h[right]))
            log.append((np.full(len(both), k), ids[left], ids[right], w[left], w[right], cost[both], height))
            s[left] += s[right]
            w[left] += w[right]
            h[left] = height
            live[right] = False
            to, merged = np.arange(len(ids)), np.zeros(len(ids), bool)
            to[right] = left
            merged[left] = merged[right] = True
            touched = merged[a] | merged[b]
            new_a, new_b = to[a[touched]], to[b[touched]]
            pair = np.unique((np.minimum(new_a, new_b) * len(ids) + np.maximum(new_a, new_b))[new_a != new_b])
            new_a, new_b = pair // len(ids), pair % len(ids)
            a, b = np.concatenate([a[~touched], new_a]), np.concatenate([b[~touched], new_b])
            cost = np.concatenate([cost[~touched], priced(new_a, new_b)])
        at = np.flatnonzero(live)
        rows = [np.concatenate(x) for x in zip(*log, (np.zeros(len(at)), ids[at], ids[at], w[at], w[at], h[at], h[at]), strict=True)]
        merges = len(rows[0]) - len(at)
        columns = [pa.array(x.astype(t)) for x, t in zip(rows, ("i4", "i8", "i8", "i8", "i8", "f8", "f8"), strict=True)]
        columns[0] = pa.concat_arrays([columns[0].slice(0, merges), pa.nulls(len(at), pa.int32())])
        sums = pa.array([None] * merges + s[at].tolist(), pa.list_(pa.float64()))
        return pa.Table.from_arrays([*columns, sums], names=["round", "left", "right", "n_left", "n_right", "cost", "height", "s"])
    return run


def ward_tree(df: DataFrame, vec_col: str = "embedding", id_col: str = "doc_id", neighbors: int = 10) -> tuple[DataFrame, DataFrame]:
    """(leaves, merges): leaves (id, leaf) number the rows; merges (round, left, right, n_left, n_right, cost, height) has
    one row for each merge, n - 1 in all.

    A cluster is named by its smallest leaf, so ``left`` is also the merged
    cluster.  ``height`` is the largest cost in the merged cluster: it never
    falls towards the root.  Rows without a vector are left out; ids are unique.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    leaves, live = global_rank(rows, ["id"], rank_col="leaf", label="ward_leaves")
    clusters = materialize(leaves.select(F.col("leaf").alias("id"), F.lit(1).cast("long").alias("w"), F.col("v").alias("s"), F.lit(0.0).alias("h")), "ward_clusters")
    dim = clusters.agg(F.max(F.size("s"))).first()[0] or 1
    logs: list[DataFrame] = []
    edges, done = None, 0
    while live > 1:
        if edges is None:
            edges = materialize(_priced(_graph(clusters, neighbors), _sent(clusters, live, dim)), "ward_edges")
        if live <= LAST_CLUSTERS:
            last = materialize(clusters.withColumn("_all", F.lit(0)).groupBy("_all").cogroup(edges.withColumn("_all_edges", F.lit(0)).groupBy("_all_edges"))
                               .applyInArrow(last_rounds(done), f"{MERGES}, s array<double>"), "ward_last")
            logs.append(last.where("round is not null").drop("s"))
            clusters = materialize(last.where("round is null").select(F.col("left").alias("id"), F.col("n_left").alias("w"), "s", F.col("height").alias("h")), "ward_clusters")
            live, done, edges = clusters.count(), last.agg(F.max("round")).first()[0], None
            continue
        done += 1
        merged = _cheapest_of_both(edges)
        sent = _sent(clusters, live, dim)
        a = sent.select(F.col("id").alias("a"), F.col("w").alias("wa"), F.col("s").alias("sa"), F.col("h").alias("ha"))
        b = sent.select(F.col("id").alias("b"), F.col("w").alias("wb"), F.col("s").alias("sb"), F.col("h").alias("hb"))
        merged = materialize(merged.join(a, "a").join(b, "b").select(
            F.lit(done).alias("round"), F.col("a").alias("left"), F.col("b").alias("right"), F.col("wa").alias("n_left"), F.col("wb").alias("n_right"),
            "cost", F.greatest("cost", "ha", "hb").alias("height"), F.zip_with("sa", "sb", lambda x, y: x + y).alias("s")), "ward_merges")
        logs.append(merged.drop("s"))
        gone = merged.select(F.explode(F.array("left", "right")).alias("id"))
        joined = merged.select(F.col("left").alias("id"), (F.col("n_left") + F.col("n_right")).alias("w"), "s", F.col("height").alias("h"))
        clusters = materialize(clusters.join(gone, "id", "left_anti").unionByName(joined), "ward_clusters")
        live -= merged.count()
        # edges of merged clusters go over to what they became and are priced again
        to = merged.select(F.explode(F.array(F.struct(F.col("left").alias("old"), F.col("left").alias("new")),
                                             F.struct(F.col("right").alias("old"), F.col("left").alias("new")))).alias("m")).select("m.*")
        at_a, at_b = (to.select(F.col("old").alias(x), F.col("new").alias(f"n{x}")) for x in ("a", "b"))
        moved = edges.join(at_a, "a", "left").join(at_b, "b", "left")
        touched = F.col("na").isNotNull() | F.col("nb").isNotNull()
        new_a, new_b = F.coalesce("na", "a"), F.coalesce("nb", "b")
        pairs = (moved.where(touched & (new_a != new_b))
                 .select(F.least(new_a, new_b).alias("a"), F.greatest(new_a, new_b).alias("b")).distinct())
        edges = materialize(moved.where(~touched).select("a", "b", "cost").unionByName(_priced(pairs, _sent(clusters, live, dim))), "ward_edges")
        if edges.isEmpty():
            edges = None
    merges = functools.reduce(DataFrame.unionByName, logs) if logs else spark.createDataFrame([], MERGES)
    return leaves.select("id", "leaf"), (materialize(merges, "ward_log") if logs else merges)


def cut_tree(leaves: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(id, cluster): the tree without its k - 1 highest merges; clusters are numbered 0.. by their smallest leaf."""
    ranked, total = global_rank(merges, ["height", "round", "left"], label="ward_cut")
    to = materialize(ranked.where(F.col("rank") < max(0, total + 1 - k)).select(F.col("right").alias("at"), F.col("left").alias("up")), "ward_up")
    while True:                                            # each step doubles how far a pointer reaches
        further = to.select(F.col("at").alias("up"), F.col("up").alias("top"))
        step = to.join(further, "up", "left")
        if step.where("top is not null").isEmpty():
            break
        to = materialize(step.select("at", F.coalesce("top", "up").alias("up")), "ward_up")
    rooted = leaves.join(to.withColumnRenamed("at", "leaf"), "leaf", "left").select("id", F.coalesce("up", "leaf").alias("root"))
    # one row for each of the k clusters
    number = rooted.select("root").distinct().select("root", (F.row_number().over(Window.orderBy("root")) - 1).alias("cluster"))
    return rooted.join(number, "root").select("id", "cluster")


def ward_clusters(df: DataFrame, k: int = 40, vec_col: str = "embedding", id_col: str = "doc_id", neighbors: int = 10) -> DataFrame:
    """Bottom-up Ward clustering of all rows into k clusters (fewer rows: one each), (id, cluster)."""
    leaves, merges = ward_tree(df, vec_col, id_col, neighbors)
    return cut_tree(leaves, merges, k).withColumnRenamed("id", id_col)
