"""N-grams of the gazetteer are read in place and match plain Python."""
from corpusgrid.operators import entities


def test_grams_in_place_match_plain_python(spark, capsys):
    texts = {1: "Red Fox runs red fox", 2: "red", 3: "", 4: None, 5: "a red  fox runs, a red fox runs", 6: "fox runs red"}
    known = [("red", "C"), ("red fox", "A"), ("red fox runs", "L"), ("fox runs red fox", "N")]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = entities.extract_gazetteer(docs, spark.createDataFrame(known, "phrase string, type string"), max_n=3)
    want = []
    for d, t in texts.items():
        w = (t or "").lower().replace(",", " , ").split()
        want += [(d, kind, i * 3 + n - 1, p) for n in (1, 2, 3) for i in range(len(w) - n + 1) for p, kind in known if " ".join(w[i:i + n]) == p]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    found.explain()
    assert "slice(" not in capsys.readouterr().out     # an array was copied for each n-gram
