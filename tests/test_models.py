import glob

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpusgrid.operators import models, two_tower
from corpusgrid.sources import store
from corpusgrid.sources.tables import read_table

from conftest import SF0001


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF0001, "documents", ["doc_id", "text", "lang"]).cache()


@pytest.fixture(scope="module")
def clf(docs):
    return models.train_classifier(docs, "text", "lang", dense_size=16, num_dense_layers=2,
                                   num_features=256, max_iter=15)


def test_weights_reproduce_spark_forward(clf, docs):
    x = models.text_features(clf.features, docs.limit(5), "text")
    out = clf.mlp.transform(x).select(vector_to_array("_features").alias("f"),
                                      vector_to_array("probability").alias("p")).collect()
    for r in out:
        h = np.array(r["f"])
        layers = clf.weights()
        for i, (w, b) in enumerate(layers):
            z = h @ w + b
            h = 1 / (1 + np.exp(-z)) if i < len(layers) - 1 else np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(h, r["p"], atol=1e-8)


def test_embeddings_width_and_round_trip(spark, clf, docs, tmp_dir):
    e1 = {r["doc_id"]: r["embedding"] for r in models.batch_embeddings(clf, docs, batch_size=7).collect()}
    assert len(e1) == docs.count() and all(len(v) == 16 for v in e1.values())
    clf.save(spark, f"{tmp_dir}/model")
    again = models.TextClassifier.load(spark, f"{tmp_dir}/model")
    e2 = {r["doc_id"]: r["embedding"] for r in models.batch_embeddings(again, docs).collect()}
    assert e1 == e2
    p = models.predict(clf, docs).collect()
    assert {r["predicted"] for r in p} <= set(clf.labels)


def test_two_tower_fit_scores_and_embeddings(spark, docs):
    right = docs.select("doc_id", F.col("text").alias("sentence"), F.col("lang").alias("label"), F.lit(1).alias("is_positive"))
    wrong = right.withColumn("label", F.when(F.col("label") == "en", "de").otherwise("en")).withColumn("is_positive", F.lit(0))
    pairs = right.unionByName(wrong)
    m = two_tower.train_two_tower(pairs, dense_size=8, num_features=128, max_iter=40, valid=pairs)
    losses = [h["loss"] for h in m.history()]
    assert losses[-1] < losses[0] and m.valid_loss < 0.69          # better than a coin
    w, b = m.text_layer()
    assert w.shape == (128, 8) and b.shape == (8,)
    x = models.text_features(m.features, docs.limit(5).withColumn("lab", F.col("lang")), "text").select(
        "doc_id", vector_to_array("_features").alias("f")).collect()
    emb = {r["doc_id"]: r["embedding"] for r in two_tower.two_tower_embeddings(m, docs).collect()}
    assert len(emb) == docs.count()
    assert all(np.allclose(emb[r["doc_id"]], np.array(r["f"]) @ w + b, atol=1e-4) for r in x)
    scores = two_tower.two_tower_scores(m, pairs).collect()
    assert len(scores) == pairs.count() and all(0 <= r["p_match"] <= 1 for r in scores)
    small = two_tower.train_two_tower(pairs, dense_size=4, num_features=32, num_dense_layers=1, max_iter=2, fit_rows=60)
    assert small.perceptron.weights.size == (32 + len(small.head.stages[0].labels) + 1) * 4 + 5 * 2


def test_store_reuse_and_export(spark, tmp_dir):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("valid"))
    a = store.materialize_or_reuse(spark, f"{tmp_dir}/t", build, partition_by=["split"])
    b = store.materialize_or_reuse(spark, f"{tmp_dir}/t", build, partition_by=["split"])
    assert a.count() == b.count() == 5 and len(calls) == 1
    df = spark.createDataFrame([(2, [0.5, 1.0], "b", 1), (1, [0.25, 2.0], "a", 0)],
                               "k long, v array<double>, text string, label int")
    paths = store.export_projector(df, f"{tmp_dir}/proj", "v", "text", "label", "k")
    lines = [r["value"] for r in spark.read.text(paths["embeddings"]).collect()]
    assert sorted(lines) == sorted(["2.500000000000000000e-01\t2.000000000000000000e+00",
                                    "5.000000000000000000e-01\t1.000000000000000000e+00"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = spark.range(400).select(F.col("id").alias("k"), F.array(F.col("id") / 10).alias("v"), F.lit("t").alias("text"),
                                   F.col("id").alias("label"))
    paths = store.export_projector(many, f"{tmp_dir}/parts", "v", "text", "label", "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = {n: [x for f in sorted(glob.glob(f"{p}/part-*")) for x in open(f).read().splitlines()] for n, p in paths.items()}
    assert read["labels"] == ["\tabstract\tlabel"] + [f"{k}\tt\t{k}" for k in range(400)]
    assert read["embeddings"] == ["%.18e" % (k / 10) for k in range(400)]
    paths2 = store.write_experiment(f"{tmp_dir}/exp", {"sentences": df.withColumn("split", F.lit("train"))},
                                    history=[{"step": 1, "loss": 0.5}])
    assert spark.read.parquet(paths2["sentences"]).count() == 2


def test_user_encoder_and_config_keyed_reuse(spark, docs, tmp_dir):
    def enc(texts):
        return np.array([[len(t), t.count(" ")] for t in texts], dtype=float)
    out = models.embed_with_function(docs, enc, dim=2, batch_size=16).collect()
    assert len(out) == docs.count() and all(len(r["embedding"]) == 2 for r in out)
    a = store.materialize_or_reuse(spark, f"{tmp_dir}/r", lambda: spark.range(3), config={"v": 1})
    b = store.materialize_or_reuse(spark, f"{tmp_dir}/r", lambda: spark.range(5), config={"v": 2})
    assert a.count() == 3 and b.count() == 5


def test_unfinished_write_is_rebuilt(spark, tmp_dir):
    import os
    p = f"{tmp_dir}/half"
    spark.range(2).write.parquet(p)
    os.remove(f"{p}/_SUCCESS")              # as if the job died before committing
    out = store.materialize_or_reuse(spark, p, lambda: spark.range(7))
    assert out.count() == 7


def test_classifier_history_and_validation(clf, docs):
    h = clf.history()
    assert len(h) >= 2 and h[-1]["loss"] <= h[0]["loss"]
    acc = models.validation_accuracy(clf, docs, "text", "lang")
    assert 0.0 <= acc <= 1.0


def test_two_tower_embeds_few_texts_at_once(monkeypatch):
    import types

    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(1)
    weights, bias, n = rng.normal(size=(6, 3)), rng.normal(size=3), 2 * two_tower.CHUNK_TEXTS + 7
    dense = [[float(rng.integers(0, 3)) for _ in range(6)] for _ in range(n)]
    sparse = [{"type": 0, "size": 6, "indices": [j for j in range(6) if r[j]], "values": [x for x in r if x]} for r in dense]
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(sparse, kind)], names=["doc_id", "_features"])
    held, plain = [], two_tower.vector_matmul
    monkeypatch.setattr(two_tower, "vector_matmul", lambda v, w: held.append(len(v)) or plain(v, w))
    out = pa.Table.from_batches(list(two_tower._embedder(types.SimpleNamespace(value=(weights, bias)), "doc_id")([batch])))
    assert max(held) <= two_tower.CHUNK_TEXTS and out.column("doc_id").to_pylist() == list(range(n))
    assert np.allclose(np.array(out.column("embedding").to_pylist()), np.array(dense) @ weights + bias, atol=1e-5)


def test_two_tower_fit_sees_every_pair(spark, monkeypatch):
    """The optimiser's rows were a hash sample of about 200,000; a lower bound shows it on a small table."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    monkeypatch.setattr(models, "FIT_ROWS", 20)
    monkeypatch.setattr(two_tower, "FIT_ROWS", 20, raising=False)
    defaults = two_tower.train_two_tower.__defaults__
    monkeypatch.setattr(two_tower.train_two_tower, "__defaults__", tuple(20 if x == 200_000 else x for x in defaults))
    pairs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("sentence"),
                                    (F.col("id") % 3).cast("string").alias("label"), (F.col("id") % 2).cast("int").alias("is_positive"))
    seen, fit = [], MultilayerPerceptronClassifier.fit

    def counted(self, df, *a, **b):
        seen.append(df.count())
        return fit(self, df, *a, **b)
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", counted)
    two_tower.train_two_tower(pairs, dense_size=2, num_features=16, max_iter=1)
    assert seen == [300]


def test_blocks_of_a_large_fit_stay_small():
    assert two_tower.block_rows(2_000, 1_046) == 128             # a small fit is as it was
    rows = two_tower.block_rows(500_000, 1_046)
    assert 1 <= rows < 128 and rows * 1_046 * 8 <= two_tower.BLOCK_BYTES and two_tower.block_rows(500_000, 10**6) == 1
