"""Word counts that pairs carry: used by the fit and the scores instead of the text; the normalisation of ASCII texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusgrid.functions.text import ACCENTED, UNACCENTED, normalize_text
from corpusgrid.operators import models, two_tower


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, f"{'red apple' if i % 2 else 'Blue whale, é'} number {i % 7}", "fruit" if (i + k) % 2 else "sea", 1 - k)
            for i in range(40) for k in range(2)]
    return spark.createDataFrame(rows + [(40, "red", None, 1)], "doc_id long, sentence string, label string, is_positive int")


def test_carried_counts_replace_the_text(spark, pairs, tmp_path):
    options = dict(dense_size=4, num_features=32, num_dense_layers=1, max_iter=5)
    plain = two_tower.train_two_tower(pairs, **options)
    expected = {(r["doc_id"], r["label"]): r["p_match"] for r in two_tower.two_tower_scores(plain, pairs).collect()}
    # the texts are gone: only the counts can tell them apart
    carried = models.with_term_counts(pairs, "sentence", 32)
    carried.write.parquet(f"{tmp_path}/counts")
    carried = spark.read.parquet(f"{tmp_path}/counts").withColumn("sentence", F.concat(F.lit("gone "), F.col("doc_id").cast("string")))
    model = two_tower.train_two_tower(carried, **options)
    found = {(r["doc_id"], r["label"]): r["p_match"] for r in two_tower.two_tower_scores(model, carried).collect()}
    assert found.keys() == expected.keys() and len(found) == 80
    assert all(abs(found[k] - expected[k]) < 1e-6 for k in found)
    # counts of another width are not taken for its own
    other = models.with_term_counts(pairs, "sentence", 16)
    assert {(r["doc_id"], r["label"]): r["p_match"] for r in two_tower.two_tower_scores(plain, other).collect()} == expected


def test_normalisation_of_ascii_and_other_texts(spark):
    texts = ["", "Plain TEXT, 1", "ÀÉ Straße", "Kelvin", "İ", None, "a\u0000B"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(normalize_text(F.col("t")).alias("now"), F.translate(F.lower("t"), ACCENTED, UNACCENTED).alias("whole")).collect()
    assert [r["now"] for r in got] == [r["whole"] for r in got]
