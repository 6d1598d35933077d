from pyspark.sql import functions as F

from corpusgrid.operators import sequences


def _vocab(spark, pieces):
    rows = [(p, i) for i, p in enumerate(pieces)]
    return spark.createDataFrame(rows, "piece string, id int")


PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "hello", "world", "un", "##aff", "##able", "!", "h", "##e"]


def test_shapes_and_padding(spark):
    docs = spark.createDataFrame([(0, "Hello"), (1, "World")], "doc_id long, text string")
    out = sequences.encode_sequences(docs, _vocab(spark, PIECES), max_seq_length=128).orderBy("doc_id").collect()
    assert [len(r["input_ids"]) for r in out] == [128, 128]
    assert out[0]["input_ids"][:4] == [2, 5, 3, 0] and out[1]["input_ids"][:3] == [2, 6, 3]
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, code int")
    oh = sequences.one_hot_labels(labels, "code", 64).orderBy("doc_id").collect()
    assert [len(r["label_onehot"]) for r in oh] == [64, 64] and oh[1]["label_onehot"][1] == 1


def test_wordpiece_and_unknown(spark):
    docs = spark.createDataFrame([(0, "unaffable hee xyz!")], "doc_id long, text string")
    r = sequences.encode_sequences(docs, _vocab(spark, PIECES), max_seq_length=12).collect()[0]
    # unaffable -> un ##aff ##able ; hee -> h ##e ##e ; xyz -> [UNK] ; ! -> !
    assert r["input_ids"] == [2, 7, 8, 9, 11, 12, 12, 1, 10, 3, 0, 0]
    assert r["n_pieces"] == 8


def test_truncation_drops_closing_marker(spark):
    docs = spark.createDataFrame([(0, "hello " * 10), (1, "")], "doc_id long, text string")
    out = sequences.encode_sequences(docs, _vocab(spark, PIECES), max_seq_length=5).orderBy("doc_id").collect()
    assert out[0]["input_ids"] == [2, 5, 5, 5, 5] and out[0]["n_pieces"] == 10
    assert out[1]["input_ids"] == [2, 3, 0, 0, 0]
    kept = sequences.encode_sequences(docs, _vocab(spark, PIECES), max_seq_length=5, keep_sep=True).orderBy("doc_id").collect()
    assert kept[0]["input_ids"] == [2, 5, 5, 5, 3]


def test_built_vocabulary_covers_every_word(spark):
    docs = spark.createDataFrame([(0, "Él comió manzanas, ¿verdad?"), (1, "Straße straße STRASSE")], "doc_id long, text string")
    v = sequences.build_vocabulary(docs, size=2)
    rows = v.collect()
    ids = sorted(r["id"] for r in rows)
    assert ids == list(range(len(rows)))
    pieces = {r["piece"] for r in rows}
    assert {"[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "straße", "e", "##l", "¿", "##¿"} <= pieces
    enc = sequences.encode_sequences(docs, v, max_seq_length=40).collect()
    assert all(1 not in r["input_ids"] for r in enc)  # no unknown piece


def test_load_vocabulary(spark, tmp_dir):
    path = f"{tmp_dir}/vocab.txt"
    with open(path, "w") as f:
        f.write("\n".join(PIECES) + "\n")
    v = {r["piece"]: r["id"] for r in sequences.load_vocabulary(spark, path).collect()}
    assert v == {p: i for i, p in enumerate(PIECES)}


def test_label_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "doc_id long, label string")
    coded, n = sequences.label_codes(df, "label", "code")
    assert n == 2 and {r["doc_id"]: r["code"] for r in coded.collect()} == {0: 1, 1: 0, 3: 1}
    kept, n2 = sequences.label_codes(df, "label", "code", handle_null="keep")
    assert n2 == 3 and {r["doc_id"]: r["code"] for r in kept.collect()}[2] == 2


def test_piece_length_limit_keeps_results():
    import random
    vocab = {p: i for i, p in enumerate(PIECES + ["unaff", "##ab", "##le", "ha", "##ee"])}
    limits = sequences.piece_limits(vocab)
    rnd = random.Random(3)
    for _ in range(2000):
        w = "".join(rnd.choice("unafblehx!") for _ in range(rnd.randint(1, 12)))
        assert sequences._wordpiece(w, vocab, 1, limits) == sequences._wordpiece(w, vocab, 1)


def test_label_codes_join_path(spark, monkeypatch):
    monkeypatch.setattr(sequences, "MAX_LITERAL_CLASSES", 1)
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "c")], "doc_id long, label string")
    coded, n = sequences.label_codes(df, "label", "code")
    assert n == 3 and {r["doc_id"]: r["code"] for r in coded.collect()} == {0: 1, 1: 0, 3: 2}
    kept, n2 = sequences.label_codes(df, "label", "code", handle_null="keep")
    assert n2 == 4 and {r["doc_id"]: r["code"] for r in kept.collect()}[2] == 3


def test_encoder_matches_plain_python(spark):
    import re

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from corpusgrid.functions.text import ACCENTED, UNACCENTED
    vocab = {p: i for i, p in enumerate(PIECES + ["ab", "##b", "##a", "a", "b", "x", "##x", "é"])}
    punct = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    word_re = re.compile(f"[^ \\t\\n\\r{punct}]+|[{punct}]")
    fold = str.maketrans(ACCENTED, UNACCENTED)

    def expected(text, length, keep_sep):
        ids = [2]
        for w in word_re.findall(text.lower().translate(fold)):
            ids += sequences._wordpiece(w, vocab, 1)
        ids.append(3)
        n = len(ids) - 2
        if len(ids) > length:
            ids = ids[:length]
            if keep_sep:
                ids[-1] = 3
        return n, ids + [0] * (length - len(ids))

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet="abXÉé ,.!q", max_size=30), min_size=1, max_size=25),
           st.integers(min_value=3, max_value=16), st.booleans())
    def check(texts, length, keep_sep):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: (r["n_pieces"], r["input_ids"]) for r in
               sequences.encode_sequences(docs, _vocab(spark, list(vocab)), max_seq_length=length,
                                          keep_sep=keep_sep).collect()}
        assert got == {i: expected(t, length, keep_sep) for i, t in enumerate(texts)}

    check()


def test_encoder_holds_few_texts_at_once():
    import types

    import pyarrow as pa
    vocab = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4, "b": 5, "##a": 6, "##b": 7}
    texts = [" ".join("ab"[(i + j) % 2] * (1 + j % 3) for j in range(i % 9)) for i in range(3 * sequences.CHUNK_TEXTS + 5)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "_w": texts})
    for rule in ("ascii", "unicode"):
        run = sequences._encoder(types.SimpleNamespace(value=vocab), 1, 2, 3, 8, False, rule)
        parts = list(run([batch]))
        assert max(p.num_rows for p in parts) <= sequences.CHUNK_TEXTS
        single = [r for i in range(len(texts)) for p in run([batch.slice(i, 1)]) for r in p.to_pylist()]
        assert pa.Table.from_batches(parts).to_pylist() == single
