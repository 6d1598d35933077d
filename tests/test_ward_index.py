"""Bottom-up Ward tree, stored vector index, committed datasets: brute force and edges."""
import threading

import numpy as np
import pytest

from corpusgrid.operators import evaluate, vector_index, vectors, ward
from corpusgrid.sources import store


def _table(spark, points, name="doc_id"):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in points], f"{name} long, embedding array<double>")


def _greedy(points):
    """Costs and members of every merge of the greedy Ward tree over a full matrix."""
    live = {i: (1, np.array(p, float), frozenset([i])) for i, p in points}
    out = []
    while len(live) > 1:
        cost, a, b = min((live[a][0] * live[b][0] / (live[a][0] + live[b][0])
                          * ((live[a][1] / live[a][0] - live[b][1] / live[b][0]) ** 2).sum(), a, b) for a in live for b in live if a < b)
        out.append((round(cost, 9), live[a][2] | live[b][2]))
        live[a] = (live[a][0] + live[b][0], live[a][1] + live[b][1], live[a][2] | live[b][2])
        del live[b]
    return out


def _members(leaves, merges):
    of = {r["leaf"]: frozenset([r["id"]]) for r in leaves.collect()}
    out = []
    for r in sorted(merges.collect(), key=lambda r: r["round"]):
        assert (r["n_left"], r["n_right"]) == (len(of[r["left"]]), len(of[r["right"]])) and r["height"] >= r["cost"] - 1e-12
        of[r["left"]] = of[r["left"]] | of.pop(r["right"])
        out.append((round(r["cost"], 9), of[r["left"]]))
    return out


def test_ward_tree_is_the_greedy_tree(spark):
    rng = np.random.default_rng(4)
    points = [(100 + 3 * i, rng.normal(size=3) * (1 + i % 4)) for i in range(24)]
    leaves, merges = ward.ward_tree(_table(spark, points), neighbors=23)
    got, want = _members(leaves, merges), _greedy(points)
    assert sorted(got, key=lambda m: (m[0], len(m[1]))) == sorted(want, key=lambda m: (m[0], len(m[1])))
    x = np.array([p for _, p in points])
    assert abs(sum(c for c, _ in got) - ((x - x.mean(0)) ** 2).sum()) < 1e-6


def test_ward_clusters(spark):
    rng = np.random.default_rng(1)
    # three blobs, a third of all rows equal, few neighbours: the graph falls apart and is built anew
    points = [(i, (rng.normal(size=4) + (i % 3) * 5) if i % 3 else np.zeros(4)) for i in range(90)]
    df = _table(spark, points)
    w = ward.ward_clusters(df, k=3, neighbors=2)
    truth = spark.createDataFrame([(i, i % 3) for i in range(90)], "doc_id long, label int")
    vm = evaluate.v_measure(w.join(truth, "doc_id"), "label", "cluster").collect()[0]
    assert w.count() == 90 and vm["v_measure"] > 0.99
    assert ward.ward_clusters(df.where("doc_id < 2"), k=5).count() == 2
    assert ward.ward_clusters(df.where("doc_id < 1"), k=1).collect()[0]["cluster"] == 0
    assert ward.ward_clusters(df.where("false"), k=2).count() == 0


def test_index(spark, tmp_dir):
    rng = np.random.default_rng(8)
    points = [(i, rng.normal(size=6) + 3 * np.eye(6)[i % 6]) for i in range(400)] + [(i, np.ones(6)) for i in range(400, 600)] + [(600, np.zeros(6))]
    df = _table(spark, points).repartition(5)
    asked = _table(spark, [(i, p) for i, p in points if i % 7 == 0], "query_id")
    index = vector_index.build_index(df, f"{tmp_dir}/index", cells=12)
    assert index.count.sum() == 600 and index.version == 1                 # the zero vector is left out
    exact = vectors.nearest_neighbors(asked, df, k=5)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(vector_index.search_index(asked, index, k=5, probes=None)) == rows(exact)
    assert rows(vector_index.search_index(asked, index, k=5, probes=None, block_size=16)) == rows(exact)
    probes = vector_index.choose_probes(index, 5, 0.95, sample=64)
    found = vector_index.search_index(asked, index, k=5, probes=probes)
    assert vector_index.recall(found, exact).collect()[0]["recall"] >= 0.9
    # one probe still brings k rows where the corpus has them
    assert vector_index.search_index(asked, index, k=150, probes=1).groupBy("query_id").count().where("count <> 150").isEmpty()
    again = vector_index.build_index(df.where("doc_id < 50"), f"{tmp_dir}/index")
    assert again.version == 2 and vector_index.open_index(spark, f"{tmp_dir}/index").count.sum() == 50
    assert vector_index.open_index(spark, f"{tmp_dir}/index", 1).count.sum() == 600
    empty = vector_index.build_index(df.where("false"), f"{tmp_dir}/none")
    assert vector_index.search_index(asked, empty).count() == 0 and vector_index.choose_probes(empty) == 1


def test_commit_protocol(spark, tmp_dir):
    path = f"{tmp_dir}/data"
    with pytest.raises(FileNotFoundError):
        store.committed(spark, path)

    def fails(folder):
        spark.range(3).write.parquet(folder)
        raise RuntimeError("builder dies")
    with pytest.raises(RuntimeError):
        store.commit(spark, path, fails)
    assert store.versions(spark, path).count() == 0
    # two builders at once: two versions, each whole
    made, barrier = [], threading.Barrier(2)

    def build(n):
        def write(folder):
            spark.range(n).write.parquet(folder)
            barrier.wait(60)
        made.append((store.commit(spark, path, write, {"n": n}), n))
    threads = [threading.Thread(target=build, args=(n,)) for n in (4, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in made) == [1, 2]
    for v, n in made:
        folder, _, config = store.committed(spark, path, v)
        assert config == {"n": n} and spark.read.parquet(folder).count() == n
    assert store.materialize_or_reuse(spark, path, lambda: spark.range(99), config={"n": 4}).count() == 4
    assert store.materialize_or_reuse(spark, path, lambda: spark.range(5), config={"n": 5}).count() == 5
    assert store.drop_old_versions(spark, path, keep=1) == [1, 2]
    assert store.committed(spark, path)[1] == 3 and store.commit(spark, path, lambda f: spark.range(1).write.parquet(f)) == 4


def test_unreadable_target_raises(spark, tmp_dir):
    path = f"{tmp_dir}/broken"
    store.materialize_or_reuse(spark, path, lambda: spark.range(3))
    folder, version, _ = store.committed(spark, path)
    store.commit(spark, path, lambda f: spark.range(1).write.parquet(f), {"other": 1})
    manifests = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/{version}.json")
    out = manifests.getFileSystem(spark._jsc.hadoopConfiguration()).create(manifests, True)
    out.write(bytearray(b"{ not json"))
    out.close()
    with pytest.raises(ValueError):
        store.materialize_or_reuse(spark, path, lambda: spark.range(5))


def test_picked_cells_and_all_cells_agree(spark, tmp_dir, monkeypatch):
    rng = np.random.default_rng(2)
    df = _table(spark, [(i, rng.normal(size=4)) for i in range(200)])
    asked = df.where("doc_id < 3").withColumnRenamed("doc_id", "query_id")
    index = vector_index.build_index(df, f"{tmp_dir}/i", cells=10)
    some = sorted(map(tuple, vector_index.search_index(asked, index, probes=2).collect()))
    monkeypatch.setattr(vector_index, "PICKED_CELLS", 0)
    assert sorted(map(tuple, vector_index.search_index(asked, index, probes=2).collect())) == some


def test_a_query_is_sent_once_for_each_slot(spark, tmp_dir, monkeypatch):
    rng = np.random.default_rng(5)
    # one cell in three is hot: its vector is held by a third of the rows
    df = _table(spark, [(i, rng.normal(size=6) if i % 3 else np.eye(6)[0]) for i in range(600)])
    asked = df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = vector_index.build_index(df, f"{tmp_dir}/i", cells=40)
    sent = []
    monkeypatch.setattr(vector_index, "materialize", lambda d, label: sent.append(vectors.materialize(d, label)) or sent[-1])
    exact = sorted(map(tuple, vector_index.search_index(asked, index, k=7, probes=None, block_size=150).collect()))
    assert exact == sorted(map(tuple, vectors.nearest_neighbors(asked, df, k=7).collect()))
    assert exact == sorted(map(tuple, vectors.nearest_neighbors(asked, df, k=7, cells=30, block_size=20).collect()))
    per_query = [r["count"] for r in sent[0].groupBy("query_id").count().collect()]
    assert len(per_query) == 30 and max(per_query) <= 7       # 40 cells in about 600 / 150 slots
    base, share = vectors.cell_slots(np.array([0, 10, 300, 0, 140, 5, 5, 1]), 150)
    assert base.tolist() == [0, 0, 1, 2, 3, 3, 3, 4] and share.tolist() == [1, 1, 2, 1, 1, 1, 1, 1]
