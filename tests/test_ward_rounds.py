"""The last rounds of the Ward tree in one task, and the neighbours' work for each core."""
import numpy as np

from corpusgrid.operators import vectors, ward


def _table(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in points], "doc_id long, embedding array<double>")


def test_last_rounds_are_the_rounds_of_the_joins(spark, monkeypatch):
    rng = np.random.default_rng(11)
    # equal rows, ties on a grid, and a graph that falls apart
    points = [(i, rng.normal(size=3) + (i % 4) * 9 if i % 5 else np.round(rng.normal(size=3))) for i in range(22)]
    df, jobs = _table(spark, points), []
    one_task = ward.materialize
    monkeypatch.setattr(ward, "materialize", lambda d, label: jobs.append(label) or one_task(d, label))
    merges = sorted(map(tuple, ward.ward_tree(df, neighbors=2)[1].collect()))
    assert len(merges) == 21 and "ward_merges" not in jobs
    monkeypatch.setattr(ward, "LAST_CLUSTERS", 0)
    by_joins = sorted(map(tuple, ward.ward_tree(df, neighbors=2)[1].collect()))
    assert jobs.count("ward_merges") > 2 and by_joins == merges
    monkeypatch.setattr(ward, "LAST_CLUSTERS", 10)
    monkeypatch.setattr(ward, "BROADCAST_VALUES", 0)
    assert sorted(map(tuple, ward.ward_tree(df, neighbors=2)[1].collect())) == merges


def test_queries_of_one_slot_are_cut_for_every_core(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = _table(spark, [(i, rng.normal(size=4)) for i in range(300)])
    asked = df.withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, vectors.nearest_neighbors(asked, df, k=3).collect()))
    groups = []
    found = vectors.best_rows

    def counted(k, digits):
        run = found(k, digits)

        def one(left, right):
            import pyarrow as pa
            out = run(left, right)
            return pa.table({"query_id": pa.array([left.num_rows], pa.int64()), "neighbor_id": pa.array([0], pa.int64()),
                             "similarity": pa.array([0.0])}) if groups else out
        return one
    monkeypatch.setattr(vectors, "LEAST_QUERIES", 30)
    assert sorted(map(tuple, vectors.nearest_neighbors(asked, df, k=3).collect())) == whole
    monkeypatch.setattr(vectors, "best_rows", counted)
    groups.append(True)
    sizes = [r["query_id"] for r in vectors.nearest_neighbors(asked, df, k=3).collect()]
    assert len(sizes) > 1 and sum(sizes) == 300      # one task had all 300 before
