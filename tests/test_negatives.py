import pytest
from pyspark.sql import functions as F

from corpusgrid.operators import corpus, entities, negatives
from corpusgrid.sources.tables import read_table

from conftest import SF0001


def test_two_texts_swap_labels(spark):
    texts = spark.createDataFrame([(0, "sentence1", "label1"), (1, "sentence2", "label2")],
                                  "doc_id long, sentence string, label string")
    mentions = spark.createDataFrame([(0, "type1", 0, "token1"), (1, "type1", 0, "token5")],
                                     "doc_id long, type string, pos int, token string")
    rows = {r["sentence"]: r["label"] for r in negatives.negative_pairs(texts, mentions, ratio=1).collect()}
    assert rows == {"sentence1": "label2", "sentence2": "label1"}


@pytest.fixture(scope="module")
def hundred(spark):
    d = read_table(spark, SF0001, "documents", ["doc_id", "text", "source"])
    d = corpus.sample_rows(d, 100, seed=7).select("doc_id", F.col("text").alias("sentence"),
                                                   F.col("source").alias("label")).cache()
    m = entities.extract_mentions(d.withColumnRenamed("sentence", "text")).cache()
    return d, m


@pytest.mark.parametrize("ratio", [0.25, 0.5, 1, 2, 5])
def test_row_count_per_ratio(spark, hundred, ratio):
    texts, mentions = hundred
    out = negatives.negative_pairs(texts, mentions, ratio=ratio)
    rows = out.collect()
    assert len(rows) == int(ratio * 100)
    own = {r["doc_id"]: r["label"] for r in texts.collect()}
    assert all(r["label"] != own[r["doc_id"]] for r in rows)
    pairs = [tuple(sorted((r["doc_id"], r["source_doc_id"]))) for r in rows]
    # each unordered pair appears at most twice (once per direction)
    assert max(pairs.count(p) for p in set(pairs)) <= 2
    assert sorted(r["neg_index"] for r in rows) == list(range(len(rows)))


def test_exhausted_pool_terminates(spark):
    texts = spark.createDataFrame([(i, f"s{i}", "same") for i in range(5)], "doc_id long, sentence string, label string")
    mentions = spark.createDataFrame([(i, "T", 0, "x") for i in range(5)], "doc_id long, type string, pos int, token string")
    out, info = negatives.negative_pairs(texts, mentions, ratio=1, max_rounds=3, return_info=True)
    assert out.count() == 0 and info["shortfall_rows"] == 5
    lonely = spark.createDataFrame([(0, "A", 0, "x"), (1, "B", 0, "y")], "doc_id long, type string, pos int, token string")
    texts2 = spark.createDataFrame([(0, "a", "l1"), (1, "b", "l2")], "doc_id long, sentence string, label string")
    out2, info2 = negatives.negative_pairs(texts2, lonely, ratio=1, max_rounds=2, return_info=True)
    assert out2.count() == 0 and info2["shortfall_rows"] == 2


def test_partition_count_does_not_change_result(spark, hundred):
    texts, mentions = hundred
    res = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        res.append(sorted(map(tuple, negatives.negative_pairs(texts, mentions, ratio=1).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]


def test_type_frequencies_sum_to_one(spark, hundred):
    _, mentions = hundred
    rows = negatives.type_frequencies(mentions).collect()
    assert abs(sum(r["frequency"] for r in rows) - 1) < 1e-12


def test_two_tower_pairs(spark):
    texts = spark.createDataFrame([(0, "sentence1", "label1"), (1, "sentence2", "label2")],
                                  "doc_id long, sentence string, label string")
    mentions = spark.createDataFrame([(0, "type1", 0, "t"), (1, "type1", 0, "u")], "doc_id long, type string, pos int, token string")
    pairs = negatives.two_tower_pairs(texts, negatives.negative_pairs(texts, mentions)).collect()
    assert len(pairs) == 4
    assert all(r["target"] == ([0, 1] if r["is_positive"] else [1, 0]) for r in pairs)


def test_negative_pairs_properties(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(st.sampled_from(["l1", "l2", "l3"]),
                              st.sets(st.sampled_from(["A", "B", "C"]), max_size=2)), min_size=2, max_size=40),
           st.sampled_from([0.5, 1.0, 2.0]))
    def check(docs, ratio):
        texts = spark.createDataFrame([(i, f"s{i}", lab) for i, (lab, _) in enumerate(docs)],
                                      "doc_id long, sentence string, label string")
        ment = [(i, t, 0, "x") for i, (_, ts) in enumerate(docs) for t in ts]
        mentions = spark.createDataFrame(ment, "doc_id long, type string, pos int, token string")
        out, info = negatives.negative_pairs(texts, mentions, ratio=ratio, max_rounds=4, return_info=True)
        rows = out.collect()
        target = int(ratio * len(docs))
        assert len(rows) == target - info.get("shortfall_rows", 0)
        own = {i: lab for i, (lab, _) in enumerate(docs)}
        types = {i: ts for i, (_, ts) in enumerate(docs)}
        for r in rows:
            assert r["label"] != own[r["doc_id"]] and r["label"] == own[r["source_doc_id"]]
            assert types[r["doc_id"]] & types[r["source_doc_id"]]
        pairs = [tuple(sorted((r["doc_id"], r["source_doc_id"]))) for r in rows]
        assert all(pairs.count(p) <= 2 for p in set(pairs))

    check()


def test_valid_pairs_are_counted(spark):
    import itertools
    import random
    rng = random.Random(3)
    types = {i: {t for t in "ABCDE" if rng.random() < 0.35} for i in range(60)}
    label = {i: rng.choice(["x", "x", "x", "y", None]) for i in range(60)}
    mentions = spark.createDataFrame([(i, t, 0, "tok") for i, ts in types.items() for t in ts for _ in range(2)], "doc_id long, type string, pos int, token string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, label string")
    want = sum(bool(types[i] & types[j]) and None not in (label[i], label[j]) and label[i] != label[j] for i, j in itertools.combinations(types, 2))
    assert negatives.valid_pairs(mentions, labels) == want
    assert negatives.valid_pairs(mentions.where("false"), labels) == 0


def test_rare_label_is_found(spark):
    n = 50_000
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("sentence"), F.when(F.col("id") == 777, "rare").otherwise("common").alias("label"))
    mentions = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("T").alias("type"), F.lit(0).alias("pos"), F.lit("x").alias("token"))
    out, info = negatives.negative_pairs(texts, mentions, ratio=0.0002, return_info=True)
    rows = out.collect()
    assert len(rows) == 10 and "shortfall_rows" not in info and info["pairs_valid"] == n - 1
    assert all(777 in (r["doc_id"], r["source_doc_id"]) for r in rows)


def test_every_valid_pair_before_a_shortfall(spark):
    texts = spark.createDataFrame([(i, f"s{i}", "b" if i == 3 else "a") for i in range(12)], "doc_id long, sentence string, label string")
    mentions = spark.createDataFrame([(i, t, 0, "x") for i in range(12) for t in ("T", "U")[:1 + i % 2]], "doc_id long, type string, pos int, token string")
    out, info = negatives.negative_pairs(texts, mentions, ratio=4, return_info=True)
    pairs = {tuple(sorted((r["doc_id"], r["source_doc_id"]))) for r in out.collect()}
    assert pairs == {tuple(sorted((3, i))) for i in range(12) if i != 3} and info["pairs_accepted"] == info["pairs_valid"] == 11
    assert info["shortfall_rows"] == 48 - 22


def test_rounds_append_draws(spark, hundred):
    texts, mentions = hundred
    whole = sorted(map(tuple, negatives.negative_pairs(texts, mentions, ratio=5).collect()))
    few = sorted(map(tuple, negatives.negative_pairs(texts, mentions, ratio=0.05).collect()))
    assert len(few) == 5 and set(few) <= set(whole)
