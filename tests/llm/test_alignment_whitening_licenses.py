"""Cross-tokenizer alignment, embedding whitening and license scans: brute force and edge tables."""
import collections
import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest

from corpusgrid.llm import license_scan, token_alignment, whitening
from corpusgrid.llm.oracle import regex_of
from corpusgrid.llm.word_tokens import vocabulary_path

SF = "/root/testdata/sf0.001"
CLASHING = "block long, pair string, v int, pos int, label string"
ODD = [(1, None), (2, ""), (3, " "), (4, "  a  b  "), (5, "a\n b\t c   d   x 　y"), (6, "x▁y"), (7, "<|endoftext|> z </s> <0x41>"),
       (7, "café naïve 你好 \U0001f600 ก"), (None, "no id"), (9, "a" * 3000), (10, "\x00 \x1c \x85 q"), (11, "it's  '' we'll 12 345 ..."),
       (12, "你" * 5000 + " " + "!?" * 4000), (13, "trail "), (14, "\n\n  \n x"), (15, "same words again"), (16, "same words again")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, repr(r)))


# ---------------------------------------------------------------- alignment
def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    values = token_alignment.byte_values()
    of_a = {k: bytes(values[c] for c in t) if all(c in values for c in t) else b"?" for t, k in a.get_vocab().items()}

    def of_b(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    docs, held = [], collections.Counter()
    for i, text in rows:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        ax, by = [of_a[k] for k in x], [of_b(k) for k in y]
        if not text or b"".join(ax) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            docs.append((i, None))
            continue
        ea, eb = np.cumsum([len(t) for t in ax]).tolist(), np.cumsum([len(t) for t in by]).tolist()
        both = sorted(set(ea) & set(eb))
        groups = ["{}|{}".format(*(",".join(str(k) for k, e in zip(ids, ends, strict=True) if lo < e <= hi) for ids, ends in ((x, ea), (y, eb))))
                  for lo, hi in zip([0, *both], both)]
        links, q = [], 0
        for p, end in enumerate(ea):
            start = ea[p - 1] if p else 0
            while q and eb[q - 1] > start:
                q -= 1
            while q < len(eb) and (eb[q - 1] if q else 0) < end:
                if eb[q] > start:
                    links.append((x[p], y[q]))
                q += 1
        docs.append((i, (len(x), len(y), groups, links)))
        held.update(set(links))
    best = collections.defaultdict(int)
    for (k, _), n in held.items():
        best[k] = max(best[k], n)
    out = [(i, 0, 0, 0, 0, 0, 0, "") if d is None else
           (i, d[0], d[1], len(d[2]), len(d[3]), sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3]),
            hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for i, d in docs]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, repr(r)))


def test_alignment(spark):
    docs = spark.createDataFrame([(*r, 1, "p", 2, 3, "l") for r in ODD], f"doc_id long, text string, {CLASHING}")
    assert rows_of(token_alignment.align(docs)) == plain_alignment(ODD)
    assert token_alignment.align(docs.where("false")).count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert rows_of(token_alignment.align(table)) == plain_alignment(rows)


@pytest.mark.parametrize("work", [1, 2, 7, 64])
def test_merge_pieces(work):
    rng = np.random.default_rng(work)
    for _ in range(60):
        last = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(last) < p)[1:], last) for p in rng.random(2))
        before_a, before_b = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(before_a[i], before_b[j]) < min(a[i], b[j])]
        ends = sorted(set(a.tolist()) & set(b.tolist()))
        i, j, group = token_alignment.overlaps(a, b, work)
        assert list(zip(i.tolist(), j.tolist())) == want
        assert group.tolist() == [sum(e <= max(before_a[x], before_b[y]) for e in ends) for x, y in want]


def test_alignment_forgets(spark, monkeypatch):
    known = token_alignment.Stretches(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    monkeypatch.setattr(token_alignment, "KEEP_STRETCHES", 3)
    body = "\n".join(t or "" for _, t in ODD).encode()
    ends = np.cumsum([len((t or "").encode()) + 1 for _, t in ODD]) - 1
    first = token_alignment.aligned_block(known, np.arange(len(ODD)), ends, body)
    again = token_alignment.aligned_block(known, np.arange(len(ODD)), ends, body)
    assert all(np.array_equal(first[k], again[k]) for k in ("stats", "digests", "pairs", "documents"))


# ---------------------------------------------------------------- whitening
def coefficients(m):
    """Characteristic polynomial by Faddeev and LeVerrier, in fractions."""
    d = len(m)
    c, part = [0] * d + [1], [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        part = [[sum(m[i][t] * part[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -Fraction(sum(m[i][t] * part[t][i] for i in range(d) for t in range(d)), k)
    return [int(x) for x in c]


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 6):
        x = rng.integers(-90, 90, (9, d)).astype(object)
        m = (x.T @ x).tolist()
        assert whitening.characteristic_polynomial(spark, m) == coefficients(m)
    # powers of two fall on the halving's own borders; equal roots count by multiplicity
    found = whitening.largest_roots(coefficients(np.diag([8, 4, 4, 2, 0]).tolist()), 8)
    assert [(round(float(r), 12), k) for r, k in found] == [(8, 1), (4, 2), (2, 1)]


def whitened_by_numpy(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    y = np.floor(1024 * np.array([v for _, v in good], float)).astype(np.int64) + 100_000
    z = y - y.mean(0)
    e, axes = np.linalg.eigh(z.T @ z / len(y))
    n, s = len(y), y.astype(object).sum(0)
    return [i for i, _ in good], e[::-1], axes[:, ::-1], z, ((n * y.astype(object) - s) ** 2).sum(1)


def test_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    out = whitening.whiten(table).toPandas()
    ids, e, axes, z, off = whitened_by_numpy(rows)
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = z @ axes[:, :8] / np.sqrt(e[:8])
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-9
    assert (out.groupby("vec_id").deviation.first().loc[ids].to_numpy() == off).all()
    explained = out.groupby("component").explained.first().to_numpy()
    assert np.abs(explained / (e[:8] / e.sum()) - 1).max() < 1e-9
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9 and (out.n == len(ids)).all()


def test_whitening_edges(spark):
    schema = f"vec_id long, embedding array<double>, {CLASHING}, component int, n int"

    def run(rows):
        return whitening.whiten(spark.createDataFrame([(*r, 1, "p", 2, 3, "l", 4, 5) for r in rows], schema)).collect()

    rng = np.random.default_rng(5)
    good = [(k, rng.normal(size=3).tolist()) for k in range(20)] + [(None, [1.0, 2.0, 3.0]), (7, [0.5, 0.5, 0.0]), (7, [0.5, 0.5])]
    bad = [(90, None), (91, [None, 1.0, 1.0]), (92, [float("nan"), 0.0, 0.0]), (93, [float("inf"), 0.0, 0.0])]
    out = run(good + bad)
    assert len(out) == 3 * len(good) and sum(r.vec_id is None for r in out) == 3 and {r.vec_id for r in out} == {i for i, _ in good}
    assert all(r.identity_error < 1e-9 and r.n == len(good) for r in out)
    same = collections.defaultdict(list)                   # a shorter vector ends in zeros
    for r in out:
        same[r.vec_id, r.component].append((r.whitened, r.deviation))
    assert all(len(set(same[7, k][-2:])) == 1 or len(same[7, k]) == 3 for k in (1, 2, 3))
    # equal eigenvalues still give an orthonormal basis
    out = run([(k, [float(k % 4 == i) for i in range(4)]) for k in range(12)])
    assert len(out) == 36 and out[0].identity_error < 1e-9 and all(abs(r.explained - 1 / 3) < 1e-9 for r in out)
    assert run([]) == [] and run([(1, [])]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    out = run([(1, [1e300, 2.0]), (2, [-1e300]), (3, [5e-324, 1e9])])
    assert len(out) == 6 and out[0].identity_error < 1e-9 and all(r.deviation is None for r in out)


# ---------------------------------------------------------------- license scans
def filled(markup, optional, replaced):
    """A template's text with or without its optional regions; replaceable ones take ``replaced``."""
    def text(parts):
        return " ".join(p if isinstance(p, str) else replaced if isinstance(p, tuple) else text(p) if optional else "" for p in parts)
    return text(license_scan.parsed(markup))


def plain_licenses(rows):
    out = []
    for i, text in rows:
        w = license_scan.ascii_words(text or "")
        at = sorted((k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split())
        spaced = "".join(f" {x} " for x in w)
        own = {label for label, markup in license_scan.TEMPLATES if re.search(regex_of(license_scan.parsed(markup)), spaced)}
        base = {label for _, label in at}
        out.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, sorted(base), sorted(base | own), 1.0 if own else 0.5 if at else 0.0))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, repr(r)))


def test_license_scans(spark):
    rows = list(ODD)
    for k, (label, markup) in enumerate(license_scan.TEMPLATES):
        whole = filled(markup, True, "some one else")
        words = filled(markup, False, "someone").split()
        rows += [(100 + 4 * k, f"Before. {whole.upper()}! after"), (101 + 4 * k, " ".join(words)),
                 (102 + 4 * k, " ".join(words[:-1])), (103 + 4 * k, " ".join(words[:3] + ["other"] + words[3:]))]
    rows += [(900, "MIT license mit-license"), (901, "gnu general\npublic license"), (902, "gnu general public"), (903, "mit license"), (904, None),
             (905, "cc by cc by cc"), (906, "ämit license mit license"), (907, "licensed under " * 5000 + "cc by-nc 4.0"),
             (908, "this x y z w is released under the MIT license")]
    docs = spark.createDataFrame([(*r, 1, "p", 2, 3, "l") for r in rows], f"doc_id long, text string, {CLASHING}")
    out = license_scan.scan_licenses(docs)
    assert rows_of(out.drop("spans")) == plain_licenses(rows)
    by_id = {r.doc_id: r for r in out.collect()}
    for k, (label, markup) in enumerate(license_scan.TEMPLATES):
        whole = by_id[100 + 4 * k]
        assert [(s.first, s.behind) for s in whole.spans if s.label == label][0] == (1, whole.n_words - 1)
        assert label in by_id[101 + 4 * k].labels and not [s for s in by_id[102 + 4 * k].spans if s.label == label and s.behind == by_id[101 + 4 * k].n_words]
    assert license_scan.scan_licenses(docs.where("false")).count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(license_scan.scan_licenses(table).drop("spans")) == plain_licenses([(r.doc_id, r.text) for r in table.collect()])


def test_license_markup():
    with pytest.raises(ValueError):
        license_scan.parsed("a <<beginOptional>> b")
    with pytest.raises(ValueError):
        license_scan.parsed("a <<endOptional>>")
    for markup in ('<<var;name="x";words="0-2">> a', "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            license_scan.Automaton(markup, {"a": 0})
