import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrid.operators import evaluate, vectors


def _brute(q, c, k):
    out = {}
    for qi, qv in q.items():
        nq = np.linalg.norm(qv)
        if nq == 0:
            continue
        sims = []
        for ci, cv in c.items():
            nc = np.linalg.norm(cv)
            if nc == 0:
                continue
            sims.append((round(float(np.dot(qv / nq, cv / nc)), 6), ci))
        sims.sort(key=lambda t: (-t[0], t[1]))
        out[qi] = [ci for _, ci in sims[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_neighbors_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    corpus = {i: rng.normal(size=8) for i in range(300)}
    corpus[5] = np.zeros(8)                        # zero vector never matches
    corpus[6] = corpus[7].copy()                   # exact tie, broken by id
    queries = {100 + i: rng.normal(size=8) for i in range(20)}
    queries[150] = corpus[7].copy()
    cdf = spark.createDataFrame([(k, v.tolist()) for k, v in corpus.items()], "doc_id long, embedding array<double>").repartition(5)
    qdf = spark.createDataFrame([(k, v.tolist()) for k, v in queries.items()], "query_id long, embedding array<double>")
    nn = vectors.nearest_neighbors(qdf, cdf, k=10, block_size=block).collect()
    got = {}
    for r in sorted(nn, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert got == _brute(queries, corpus, 10)
    assert got[150][:2] == [6, 7]
    assert all(5 not in v for v in got.values())


def test_fewer_rows_than_k(spark):
    cdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    qdf = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<double>")
    nn = vectors.nearest_neighbors(qdf, cdf, k=10).orderBy("rank").collect()
    assert [(r["rank"], r["neighbor_id"]) for r in nn] == [(1, 1), (2, 2)]


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, embedding array<double>")
    out = {r["id"]: r["unit"] for r in vectors.unit_vectors(df).collect()}
    assert out[1] == [0.6, 0.8] and out[2] is None


def _sk_vmeasure(labels, clusters):
    n = len(labels)
    def H(xs):
        return -sum(c / n * math.log(c / n) for c in Counter(xs).values())
    cells = Counter(zip(labels, clusters))
    a, b = Counter(labels), Counter(clusters)
    hck = -sum(v / n * math.log(v / b[k]) for (c, k), v in cells.items())
    hkc = -sum(v / n * math.log(v / a[c]) for (c, k), v in cells.items())
    h = 1.0 if H(labels) == 0 else 1 - hck / H(labels)
    c = 1.0 if H(clusters) == 0 else 1 - hkc / H(clusters)
    return h, c, (0.0 if h + c == 0 else 2 * h * c / (h + c))


@pytest.mark.parametrize("labels,clusters", [
    ([0, 0, 1, 1, 2, 2], [5, 5, 3, 3, 9, 9]),          # identical partitions -> 1
    ([0, 1, 2, 0, 1, 2], [1, 1, 1, 1, 1, 1]),          # one cluster vs several labels -> 0
    ([0, 0, 0, 1, 1, 1, 2, 2, 2, 2], [0, 0, 1, 1, 1, 2, 2, 2, 0, 3]),
])
def test_v_measure(spark, labels, clusters):
    df = spark.createDataFrame(list(zip(labels, clusters)), "label int, cluster int")
    r = evaluate.v_measure(df, "label", "cluster").collect()[0]
    h, c, v = _sk_vmeasure(labels, clusters)
    assert abs(r["homogeneity"] - h) < 1e-9 and abs(r["completeness"] - c) < 1e-9 and abs(r["v_measure"] - v) < 1e-9


def test_accuracy_argmax_ties_first(spark):
    df = spark.createDataFrame([([0.5, 0.5], [1, 0]), ([0.1, 0.9], [0, 1]), ([0.7, 0.2], [0, 1])],
                               "p array<double>, t array<int>")
    r = evaluate.accuracy(df, "p", "t").collect()[0]
    assert abs(r["accuracy"] - 2 / 3) < 1e-12 and r["n"] == 3


def test_clusterings_cover_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) + (i % 3) * 5).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    for fn in (evaluate.kmeans_clusters, evaluate.bisecting_clusters):
        out = fn(df, k=3).collect()
        assert len(out) == 120


def test_neighbors_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_QUERIES", 3)
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(11)
    corpus = {i: rng.normal(size=5) for i in range(200)}
    queries = {1000 + i: rng.normal(size=5) for i in range(25)}
    cdf = spark.createDataFrame([(k, v.tolist()) for k, v in corpus.items()], "doc_id long, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame([(k, v.tolist()) for k, v in queries.items()], "query_id long, embedding array<double>")
    nn = vectors.nearest_neighbors(qdf, cdf, k=7).collect()
    got = {}
    for r in sorted(nn, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert got == _brute(queries, corpus, 7)


def test_accuracy_matches_spark_ml_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        p = rng.random(4).tolist()
        t = int(rng.integers(0, 4))
        rows.append((p, [int(j == t) for j in range(4)], float(int(np.argmax(p))), float(t)))
    df = spark.createDataFrame(rows, "p array<double>, t array<int>, prediction double, label double")
    ours = evaluate.accuracy(df, "p", "t").collect()[0]["accuracy"]
    ml = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)
    assert abs(ours - ml) < 1e-12


@pytest.mark.parametrize("cells,block", [(1, 64), (12, 65536), (12, 50)])
def test_neighbors_hot_vector_and_string_ids(spark, cells, block):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 5)) * 4
    vecs = middle[rng.integers(0, 6, 300)] + rng.normal(size=(300, 5)) * 0.2
    vecs[::3] = [1.0, 2.0, 3.0, 4.0, 5.0]                       # a third of the rows is one vector
    rows = [(f"d{i:03d}", [float(v) for v in x]) for i, x in enumerate(vecs)]
    df = spark.createDataFrame(rows, "doc_id string, embedding array<double>")
    asked = df.withColumnRenamed("doc_id", "query_id")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    got = {}
    for r in vectors.nearest_neighbors(asked, df, k=8, cells=cells, block_size=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    for i in range(300):
        assert got[f"d{i:03d}"] == [f"d{j:03d}" for j in np.lexsort((np.arange(300), -sims[i]))[:8]]
