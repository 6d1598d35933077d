"""Toxic spans by a linear-chain conditional random field over tokens.

A bounded sample of labelled documents gives the token features (hashed words
and word beginnings that stand in toxic documents far more often than chance)
and the training sequences.  Scoring runs forward-backward over every whole
text; tokens without a feature all have the same potentials, so the chain
crosses a stretch of them by one precomputed matrix power and the marginals are
exact.  They aggregate to a document score and to offending byte offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.common import Hasher, gather, id_column, id_text, kept, ready, starts_of, word_segments

#: Labelled documents used for the fit, at most, by hash of their id; the field itself is fitted on the
#: first FIELD_SAMPLE of each label that have at most FIELD_TOKENS tokens.  Scoring has no such bounds.
FIT_TOXIC, FIT_CLEAN = 6_000, 18_000
FIELD_SAMPLE, FIELD_TOKENS = 700, 1_000
MAX_FEATURES = 4_000
PREFIXES = (4, 5, 6)
STEPS = 60
SPAN = 0.5
_HASHER = Hasher(808, lower=True)
_KIND = np.random.default_rng(88).integers(1, 1 << 63, 1 + len(PREFIXES), dtype=np.uint64)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def token_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, features) of the letter runs; features has one row of hashes per token, 0 where
    the token is shorter than a beginning."""
    starts, ends, rows = [], [], []
    for at, piece in word_segments(data):
        on = np.zeros(len(piece) + 2, bool)
        on[1:-1] = _LETTER[piece]
        edge = np.flatnonzero(on[1:] != on[:-1])
        s, e = edge[0::2], edge[1::2]
        prefix = _HASHER.prefix(piece)
        f = np.zeros((len(s), len(_KIND)), np.uint64)
        f[:, 0] = _HASHER.of(prefix, s, e) ^ _KIND[0]
        for k, n in enumerate(PREFIXES):
            long = e - s > n
            f[long, k + 1] = _HASHER.of(prefix, s[long], s[long] + n) ^ _KIND[k + 1]
        starts.append(s + at)
        ends.append(e + at)
        rows.append(f)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(_KIND)), np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)


def _lookup(vocabulary: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Index of each feature in the ascending vocabulary, -1 if it is none."""
    if not len(vocabulary):
        return np.full(features.shape, -1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, features), len(vocabulary) - 1)
    return np.where(vocabulary[at] == features, at, -1)


# --- the field ----------------------------------------------------------------------------

def marginals(u: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(token toxic) for padded log-odds ``u`` (texts x tokens), and the expected transitions (2 x 2).

    ``t`` holds the transition potentials; a text starts from a clean state.
    """
    m, e = np.exp(t), np.exp(np.clip(u, -30, 30))
    n, steps = u.shape
    alpha = np.zeros((steps + 1, n, 2))
    alpha[0, :, 0] = 1
    for k in range(steps):
        a = alpha[k] @ m
        a[:, 1] *= e[:, k]
        alpha[k + 1] = a / a.sum(1, keepdims=True)
    p, pairs, beta = np.zeros((n, steps)), np.zeros((2, 2)), np.ones((n, 2))
    for k in range(steps - 1, -1, -1):
        beta = np.where((k >= length - 1)[:, None], 1.0, beta)
        live = k < length
        g = alpha[k + 1] * beta
        p[:, k] = np.where(live, g[:, 1] / g.sum(1), 0)
        out = beta.copy()
        out[:, 1] *= e[:, k]
        xi = alpha[k][:, :, None] * m[None] * out[:, None, :]
        pairs += (xi / xi.sum((1, 2), keepdims=True))[live].sum(0)
        beta = out @ m.T
        beta /= beta.sum(1, keepdims=True)
    return p, pairs


def fit_field(texts: list[np.ndarray], toxic: np.ndarray, n_features: int, steps: int = STEPS) -> dict:
    """Weights from texts (tokens x features, vocabulary indices or -1); a token of a toxic text counts as
    toxic if it has a feature."""
    length = np.array([len(x) for x in texts])
    width = int(length.max(initial=1))
    index = np.full((len(texts), width, texts[0].shape[1] if texts else 1), -1, np.int64)
    for i, x in enumerate(texts):
        index[i, :len(x)] = x
    has = index >= 0
    y = (has.any(2) & toxic[:, None]).astype(float)
    before = np.concatenate([np.zeros((len(texts), 1)), y[:, :-1]], 1)
    inside = np.arange(width)[None] < length[:, None]
    seen = np.array([[((before == i) & (y == j) & inside).sum() for j in (0, 1)] for i in (0, 1)], float)
    w, t = np.zeros(n_features + 1), np.zeros((2, 2))        # the last weight is the bias
    w[-1] = -3
    move = [np.zeros_like(w), np.zeros_like(t)]
    speed = [np.zeros_like(w), np.zeros_like(t)]
    for k in range(1, steps + 1):
        u = np.where(has, w[index], 0).sum(2) + w[-1]
        p, pairs = marginals(u, length, t)
        d = np.where(inside, y - p, 0)
        gw = np.bincount(index[has], weights=np.broadcast_to(d[:, :, None], has.shape)[has], minlength=n_features + 1).astype(float)
        gw[-1] = d.sum()
        for j, (x, g) in enumerate(((w, gw - 0.02 * w), (t, seen - pairs - 0.02 * t))):
            move[j] = 0.9 * move[j] + 0.1 * g
            speed[j] = 0.99 * speed[j] + 0.01 * g * g
            x += 0.25 * (move[j] / (1 - 0.9 ** k)) / (np.sqrt(speed[j] / (1 - 0.99 ** k)) + 1e-8)
        t -= t[0, 0]
    return {"w": w, "t": t}


class Chain:
    """Exact marginals of the tokens that have a feature; stretches without one are matrix powers."""

    def __init__(self, field: dict, reach: int = 4096):
        self.m = np.exp(field["t"])
        self.w = field["w"]
        plain = self.m * np.array([1.0, np.exp(field["w"][-1])])
        self.power = np.empty((reach + 1, 2, 2))
        self.power[0] = np.eye(2)
        for k in range(1, reach + 1):                     # scaled; converged long before `reach`
            x = self.power[k - 1] @ plain
            self.power[k] = x / x.sum()

    def __call__(self, index: np.ndarray, where: np.ndarray, text: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
        """``index``: features of the tokens that have one, ``where``: their place in their ``text`` (ascending)."""
        p = np.zeros(len(where))
        if not len(where):
            return p
        e = np.exp(np.clip(np.where(index >= 0, self.w[index], 0).sum(1) + self.w[-1], -30, 30))
        cap = len(self.power) - 1
        first = np.concatenate([[True], text[1:] != text[:-1]])
        begin = np.flatnonzero(first)
        count = np.diff(np.concatenate([begin, [len(text)]]))
        gap = np.where(first, where, where - np.concatenate([[0], where[:-1]]) - 1)
        tail = n_tokens[text[begin]] - where[begin + count - 1] - 1
        order = np.argsort(-count, kind="stable")
        begin, count, tail = begin[order], count[order], tail[order]
        alpha = np.zeros((len(where), 2))
        a = np.zeros((len(begin), 2))
        a[:, 0] = 1
        lanes = np.searchsorted(-count, -np.arange(count[0]), "left")
        for k in range(count[0]):
            n = lanes[k]
            i = begin[:n] + k
            x = np.einsum("ni,nij->nj", a[:n], self.power[np.minimum(gap[i], cap)]) @ self.m
            x[:, 1] *= e[i]
            a[:n] = alpha[i] = x / x.sum(1, keepdims=True)
        b = np.einsum("nij->ni", self.power[np.minimum(tail, cap)])
        for k in range(count[0] - 1, -1, -1):
            n = lanes[k]
            i = begin[:n] + k
            last = count[:n] - 1 == k
            if k < count[0] - 1:
                nxt = np.minimum(i + 1, len(where) - 1)
                out = b[:n].copy()
                out[:, 1] *= e[nxt]
                back = np.einsum("nij,nj->ni", self.power[np.minimum(gap[nxt], cap)], out @ self.m.T)
                b[:n] = np.where(last[:, None], b[:n], back / back.sum(1, keepdims=True))
            g = alpha[i] * b[:n]
            p[i] = g[:, 1] / g.sum(1)
        return p


# --- fit and score over tables -------------------------------------------------------------

def _measures(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: log-odds of the highest marginal, log of the expected toxic tokens."""
    top = np.full(n, 1e-6)
    np.maximum.at(top, text, np.clip(p, 1e-6, 1 - 1e-6))
    return np.stack([np.log(top / (1 - top)) / 5, np.log1p(np.bincount(text, weights=p, minlength=n))], 1)


def _texts(batches: Iterator[pa.RecordBatch]):
    for ids, ends, body in gather(batches):
        start, end, f = token_features(np.frombuffer(body, np.uint8))
        yield ids, ends, start, end, f, np.searchsorted(ends, start)


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, _, _, f, text in _texts(batches):
        pairs = np.unique(np.stack([np.repeat(text, f.shape[1]).astype(np.uint64), f.ravel()], 1)[f.ravel() != 0], axis=0)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids[pairs[:, 0].astype(np.int64)]), "f": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model from texts and ``labels`` (doc_id, toxic).  Rows with a null id or label are left out; an id
    labelled more than once counts as toxic if any of its labels is 1.  Without toxic or clean rows the
    model scores every text 0."""
    spark = docs.sparkSession
    ready(spark)
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic")))
    picked = None
    for value, most in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        part = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # at most FIT_TOXIC + FIT_CLEAN rows: bounded, so broadcast
    texts = id_text(docs, id_col, text_col).where(F.col("id").isNotNull())
    sample = texts.join(F.broadcast(picked), F.col("id") == F.col("label_id")).select("id", "text", "toxic")
    sample = kept(sample.dropDuplicates(["id"]), "toxicity-sample")
    truth = {r["id"]: r["toxic"] for r in sample.select("id", "toxic").collect()}
    n_toxic = sum(truth.values())
    empty = {"vocabulary": np.zeros(0, np.uint64), "field": None, "logit": np.zeros(3)}
    if not 0 < n_toxic < len(truth):
        return empty
    share = n_toxic / len(truth)
    features = (sample.select("id", "text").mapInArrow(_distinct_features, "id long, f long")
                .join(F.broadcast(picked), F.col("id") == F.col("label_id")).groupBy("f")
                .agg(F.sum("toxic").cast("double").alias("k"), F.count("*").cast("double").alias("n")))
    q = F.col("k") / F.col("n")
    gain = F.col("n") * (q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0))
    tested = len(truth) * 10
    best = (features.where((F.col("k") > 0) & (q > share)).withColumn("gain", gain)
            .where(F.col("gain") > float(np.log(tested) + 3)).orderBy(F.desc("gain"), "f").limit(MAX_FEATURES))
    vocabulary = np.sort(np.array([r["f"] for r in best.select("f").collect()], np.int64).view(np.uint64))
    if not len(vocabulary):
        return empty
    found = []
    for value in (1, 0):
        ids = sorted((i for i, y in truth.items() if y == value), key=lambda i: i * 2654435761 % 4294967296)
        found += ids[:3 * FIELD_SAMPLE]
    chosen = spark.createDataFrame([(i,) for i in found], "cid long")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, _, f, text in _texts(batches):
            index = _lookup(vocabulary, f)
            n = np.bincount(text, minlength=len(ids))
            edge = np.concatenate([[0], np.cumsum(n)])
            hit = (index >= 0).any(1)
            keep = [np.flatnonzero(hit[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids), "n": pa.array(n.astype(np.int64)), "at": [k.astype(np.int64).tobytes() for k in keep],
                "index": [index[a + k].astype(np.int64).tobytes() for a, k in zip(edge[:-1], keep, strict=True)]})

    rows = (sample.join(F.broadcast(chosen), F.col("id") == F.col("cid")).select("id", "text")
            .mapInArrow(sequences, "id long, n long, at binary, index binary").collect())
    rows.sort(key=lambda r: r["id"])
    width = 1 + len(PREFIXES)
    where = [np.frombuffer(r["at"], np.int64) for r in rows]
    index = [np.frombuffer(r["index"], np.int64).reshape(-1, width) for r in rows]
    toxic = np.array([truth[r["id"]] == 1 for r in rows])
    n = np.array([r["n"] for r in rows], np.int64)
    texts_, marks, left = [], [], {True: FIELD_SAMPLE, False: FIELD_SAMPLE}
    for k in range(len(rows)):
        kind = bool(toxic[k])
        if left[kind] and 0 < n[k] <= FIELD_TOKENS:
            left[kind] -= 1
            full = np.full((int(n[k]), width), -1, np.int64)
            full[where[k]] = index[k]
            texts_.append(full)
            marks.append(kind)
    field = fit_field(texts_, np.array(marks, bool), len(vocabulary))
    text = np.repeat(np.arange(len(rows)), [len(x) for x in where])
    p = Chain(field)(np.concatenate(index), np.concatenate(where), text, n)
    return {"vocabulary": vocabulary, "field": field, "logit": _logistic(_measures(p, text, len(rows)), toxic, share)}


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights (last: intercept) by Newton steps; rows weigh as in the whole fit sample."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    c = np.where(y, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(3)
        w += np.linalg.solve(h, x.T @ (c * (y - p)) - 0.3 * w)
    return w


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and spans (byte start, byte end, marginal of toxic tokens).

    Whole texts are read.  Null and empty texts have no token and get the score
    of a text without any sign.  Equal rows get equal scores.
    """
    spark = docs.sparkSession
    ready(spark)
    held = spark.sparkContext.broadcast(model)                 # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        chain = Chain(m["field"]) if m["field"] else None
        for ids, ends, start, end, f, text in _texts(batches):
            index = _lookup(m["vocabulary"], f)
            hit = np.flatnonzero((index >= 0).any(1))
            n = np.bincount(text, minlength=len(ids))
            place = hit - (np.cumsum(n) - n)[text[hit]]
            p = chain(index[hit], place, text[hit], n) if chain else np.zeros(0)
            z = np.concatenate([_measures(p, text[hit], len(ids)), np.ones((len(ids), 1))], 1) @ m["logit"]
            s = 1 / (1 + np.exp(-z)) if chain else np.zeros(len(ids))
            bad = hit[p >= SPAN]
            base = starts_of(ends)[text[bad]]
            edge = np.searchsorted(text[bad], np.arange(len(ids) + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays(
                [pa.array(start[bad] - base), pa.array(end[bad] - base), pa.array(p[p >= SPAN])], names=["start", "end", "p"]))
            yield pa.RecordBatch.from_arrays([id_column(ids), pa.array(s), spans], names=["doc_id", "score", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")
