"""W24 k-means, W27 hierarchical clustering, W25 accuracy, W26 V-measure.

All rows are clustered; nothing is sampled to fit memory.

* W24: ``pyspark.ml.clustering.KMeans`` over the vectors.
* W27: ``BisectingKMeans`` (divisive); the bottom-up form is in ``ward``.
* W25: share of rows whose argmax of the prediction equals the argmax of the
  truth (first index on ties) -- one aggregate.
* W26: homogeneity, completeness and V-measure from the contingency table of
  (label, cluster) counts, using
  H(C) = ln N - A/N, H(K) = ln N - B/N, H(C|K) = (B - X)/N, H(K|C) = (A - X)/N
  with A = sum a ln a over label sizes, B over cluster sizes, X = sum n ln n over
  cells -- three partial aggregates, no join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions.arrays import argmax, with_unit_vector


def _features(df: DataFrame, vec_col: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(vec_col).cast("array<double>")))


def kmeans_clusters(df: DataFrame, k: int = 40, vec_col: str = "embedding", id_col: str = "doc_id",
                    seed: int = 42, max_iter: int = 20) -> DataFrame:
    """(id, cluster)."""
    f = _features(df, vec_col)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster").fit(f)
    return model.transform(f).select(id_col, "cluster")


def bisecting_clusters(df: DataFrame, k: int = 40, vec_col: str = "embedding", id_col: str = "doc_id",
                       seed: int = 42) -> DataFrame:
    """W27 (a): divisive hierarchical clustering, (id, cluster)."""
    f = _features(df, vec_col)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(f)
    return model.transform(f).select(id_col, "cluster")


def accuracy(df: DataFrame, pred_col: str, truth_col: str) -> DataFrame:
    """One row (accuracy, n)."""
    hit = (argmax(F.col(pred_col)) == argmax(F.col(truth_col))).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def v_measure(df: DataFrame, label_col: str, cluster_col: str, beta: float = 1.0) -> DataFrame:
    """One row (homogeneity, completeness, v_measure, n)."""
    cells = df.groupBy(label_col, cluster_col).agg(F.count(F.lit(1)).alias("n"))
    nlogn = lambda c: c * F.log(c)
    x = cells.select(F.lit("x").alias("kind"), F.col("n").alias("n"), nlogn(F.col("n")).alias("v"))
    a = cells.groupBy(label_col).agg(F.sum("n").alias("s")).select(
        F.lit("a").alias("kind"), F.lit(0).cast("long").alias("n"), nlogn(F.col("s")).alias("v"))
    b = cells.groupBy(cluster_col).agg(F.sum("n").alias("s")).select(
        F.lit("b").alias("kind"), F.lit(0).cast("long").alias("n"), nlogn(F.col("s")).alias("v"))
    tot = x.unionByName(a).unionByName(b).agg(
        F.sum("n").alias("N"),
        F.sum(F.when(F.col("kind") == "x", F.col("v"))).alias("X"),
        F.sum(F.when(F.col("kind") == "a", F.col("v"))).alias("A"),
        F.sum(F.when(F.col("kind") == "b", F.col("v"))).alias("B"))
    n = F.col("N").cast("double")
    h_c = F.log(n) - F.col("A") / n
    h_k = F.log(n) - F.col("B") / n
    hom = F.when(h_c <= 1e-15, F.lit(1.0)).otherwise(1 - ((F.col("B") - F.col("X")) / n) / h_c)
    com = F.when(h_k <= 1e-15, F.lit(1.0)).otherwise(1 - ((F.col("A") - F.col("X")) / n) / h_k)
    out = tot.select(hom.alias("homogeneity"), com.alias("completeness"), F.col("N").alias("n"))
    v = F.when(F.col("homogeneity") + F.col("completeness") == 0, F.lit(0.0)).otherwise(
        (1 + beta) * F.col("homogeneity") * F.col("completeness")
        / (beta * F.col("homogeneity") + F.col("completeness")))
    return out.select("homogeneity", "completeness", v.alias("v_measure"), "n")


def class_centroids(df: DataFrame, vec_col: str, label_col: str, dim: int | None = None) -> DataFrame:
    """(label, centroid array<double>) = mean unit vector per label.

    ``Summarizer.mean`` is one vectorised aggregate with a partial (map-side)
    phase, so a label holding a third of the rows costs one partial row per task.
    """
    u = (with_unit_vector(df.select(F.col(label_col).alias("label"), F.col(vec_col).alias("_v")), "_v", "u", drop_zero=True)
         .select("label", array_to_vector("u").alias("u")))
    return u.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("u"))).alias("centroid"))


def _centroid_scorer(bc, id_col: str):
    def score(batches):
        labels, cmat = bc.value
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            x = rb.column("_u").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            s = x @ cmat.T
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col), pa.array(list(s), type=pa.list_(pa.float64()))],
                names=[id_col, "scores"])
    return score


def nearest_centroid_scores(df: DataFrame, centroids: DataFrame, vec_col: str = "embedding",
                            id_col: str = "doc_id", max_classes: int = 100_000) -> tuple[DataFrame, list]:
    """(id, scores array<double>): dot product of each unit vector with every class
    centroid, classes in ascending label order; returns (frame, labels).

    The centroid table is one row per class (checked against ``max_classes``)
    and shipped as a broadcast matrix; scoring is a narrow Arrow map.
    """
    rows = centroids.orderBy("label").limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError("too many classes to broadcast")
    labels = [r["label"] for r in rows]
    cmat = np.array([r["centroid"] for r in rows], dtype=np.float64)
    bc = df.sparkSession.sparkContext.broadcast((labels, cmat))
    u = (with_unit_vector(df.select(F.col(id_col), F.col(vec_col).alias("_v")), "_v", "_u", drop_zero=True).select(id_col, "_u"))
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, scores array<double>"
    return u.mapInArrow(_centroid_scorer(bc, id_col), schema), labels
