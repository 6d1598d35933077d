import math

from pyspark.sql import functions as F

from corpusgrid.operators import entities, specificity


def _f1_mentions(spark):
    """Fixture F1: token counts 2,4,5,3,2,2 over two alternating types; texts 1-6 hold
    one token each, text 7 holds token1 and token4; counting table separate."""
    counts = [2, 4, 5, 3, 2, 2]
    table = []
    for i, c in enumerate(counts):
        table += [(f"token{i + 1}", f"type{i % 2 + 1}")] * c
    token_df = spark.createDataFrame([(100 + n, "x", n, t, ty) for n, (t, ty) in enumerate(table)],
                                     "doc_id long, _unused string, pos int, token string, type string")
    texts = [[("token1", "type1")], [("token2", "type2")], [("token3", "type1")], [("token4", "type2")],
             [("token5", "type1")], [("token6", "type2")], [("token1", "type1"), ("token4", "type2")]]
    rows = [(i + 1, p, t, ty) for i, lst in enumerate(texts) for p, (t, ty) in enumerate(lst)]
    mentions = spark.createDataFrame(rows, "doc_id long, pos int, token string, type string")
    return counts, token_df.select("doc_id", "type", "pos", "token"), mentions


def test_token_scores_golden(spark):
    counts, token_df, mentions = _f1_mentions(spark)
    scores = specificity.token_specificity(token_df)
    got = {r["token"]: (r["count"], r["mean_count"], r["score"]) for r in scores.collect()}
    for i, c in enumerate(counts):
        cnt, mean, score = got[f"token{i + 1}"]
        assert cnt == c and abs(mean - 3.0) < 1e-12
        assert abs(score - math.log(c / 3)) < 1e-5


def test_article_scores_golden(spark):
    counts, token_df, mentions = _f1_mentions(spark)
    art = specificity.article_specificity(mentions, specificity.token_specificity(token_df))
    got = {r["doc_id"]: r["score"] for r in art.collect()}
    expected = [math.log(c / 3) for c in counts]
    expected.append((expected[0] + expected[3]) / 2)
    assert len(got) == 7
    for i, e in enumerate(expected):
        assert abs(got[i + 1] - e) < 1e-5


def test_text_without_mentions_gets_null(spark):
    docs = spark.createDataFrame([(1, "Hello Wonderful World"), (2, "no capitals here"), (3, "")],
                                 "doc_id long, text string")
    out = {r["doc_id"]: (r["n_mentions"], r["score"]) for r in specificity.specificity_scores(docs).collect()}
    assert out[2] == (0, None) and out[3] == (0, None)
    assert out[1][0] == 3 and out[1][1] is not None


def test_one_score_per_text(spark):
    sents = ["Rivers in Oregon flooded after the storm", "no entities at all here",
             "Martha met Jonas at the Lisbon station in 2019", "Quarterly numbers: 4521 units, 17 returns",
             "write to desk@example.org about Berlin"]
    docs = spark.createDataFrame(list(enumerate(sents)), "doc_id long, text string")
    assert specificity.specificity_scores(docs).count() == len(sents)


def test_unseen_pair_modes(spark):
    scores = spark.createDataFrame([("CAP", "Alpha", 2, 2.0, 0.0)], "type string, token string, count long, mean_count double, score double")
    m = spark.createDataFrame([(1, "CAP", 0, "Alpha"), (1, "CAP", 1, "Beta")], "doc_id long, type string, pos int, token string")
    row = specificity.article_specificity(m, scores).collect()[0]
    assert row["score"] == 0.0 and row["n_mentions"] == 2
    import pytest
    with pytest.raises(Exception):
        specificity.article_specificity(m, scores, on_unseen="error").collect()


def test_rule_extractor_positions(spark):
    docs = spark.createDataFrame([(7, "Alpha beta Gamma 12 x 345 mail a.b@c.d")], "doc_id long, text string")
    rows = sorted((r["type"], r["pos"], r["token"]) for r in entities.extract_mentions(docs).collect())
    assert rows == [("CAP", 0, "Alpha"), ("CAP", 1, "Gamma"), ("MAIL", 0, "a.b@c.d"),
                    ("NUM", 0, "12"), ("NUM", 1, "345")]


def test_gazetteer_extractor(spark):
    docs = spark.createDataFrame([(1, "We met in New York and new york again; York!")], "doc_id long, text string")
    gaz = spark.createDataFrame([("new york", "GPE"), ("york", "GPE")], "phrase string, type string")
    rows = entities.extract_gazetteer(docs, gaz, max_n=2).collect()
    toks = sorted(r["token"] for r in rows)
    assert toks == ["new york", "new york", "york", "york", "york"]
    assert len({(r["doc_id"], r["type"], r["pos"]) for r in rows}) == len(rows)


def test_function_extractor(spark):
    def fn(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                for i, w in enumerate(w for w in t.split() if w.isupper()):
                    out.append((d, "ACRO", i, w))
            yield pd.DataFrame(out, columns=["doc_id", "type", "pos", "token"])
    docs = spark.createDataFrame([(1, "NASA and ESA"), (2, "none")], "doc_id long, text string")
    rows = entities.extract_with_function(docs, fn).collect()
    assert sorted(r["token"] for r in rows) == ["ESA", "NASA"]
