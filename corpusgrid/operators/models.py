"""W19 text-label classifier and W23 batch embeddings.

The transformer encoder of the reference is not rebuilt (see README): text
features are Spark ML ``HashingTF`` + ``IDF`` over the same word split used by
the sequence encoder, and the classifier head is Spark ML's
``MultilayerPerceptronClassifier`` with ``num_dense_layers`` hidden layers of
``dense_size`` units.

W23 embeds texts with a fitted model: the output of the last hidden dense
layer *before* its activation, computed per Arrow batch by a numpy forward
pass (weights shipped once as a broadcast variable), sparse feature vectors
multiplied without densifying.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.functions.text import words
from corpusgrid.operators.sequences import label_codes


#: The text-label classifier's optimiser sees about this many rows, drawn by hash; features, predictions and embeddings cover all.
FIT_ROWS = 200_000
DRAWS = 1 << 30
#: Labels are columns of the output layer and come to the driver; more than this is refused.
MAX_LABELS = 10_000


# ----------------------------------------------------------------- features
def _with_words(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("_words", words(F.col(text_col)))


def _counts_column(text_col: str, num_features: int) -> str:
    return f"_tf_{text_col}_{num_features}"


def with_term_counts(df: DataFrame, text_col: str = "text", num_features: int = 4096) -> DataFrame:
    """``df`` with the hashed word counts of its texts, which the functions below then use instead of cutting the words again."""
    tf = HashingTF(inputCol="_words", outputCol=_counts_column(text_col, num_features), numFeatures=num_features)
    return tf.transform(_with_words(df, text_col)).drop("_words")


def fit_text_features(df: DataFrame, text_col: str = "text", num_features: int = 4096) -> PipelineModel:
    """HashingTF + IDF over the normalised words of the whole text."""
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    counts = _counts_column(text_col, num_features)
    if counts in df.columns:
        return PipelineModel([tf, idf.fit(df.select(F.col(counts).alias("_tf")))])
    return Pipeline(stages=[tf, idf]).fit(_with_words(df, text_col))


def text_features(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    tf, idf = model.stages
    counts = _counts_column(text_col, tf.getNumFeatures())
    if counts in df.columns:
        return idf.transform(df.withColumnRenamed(counts, "_tf")).drop("_tf")
    return model.transform(_with_words(df, text_col)).drop("_words", "_tf")


def sparse_parts(vec: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the non-zeros of an ML vector column given as the
    Arrow struct (type, size, indices, values); dense rows give every column."""
    n = len(vec)
    kinds = vec.field("type").to_numpy(zero_copy_only=False)
    vals = vec.field("values")
    lens = vals.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    v = vals.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = np.repeat(np.arange(n), lens)
    if (kinds == 0).all():
        cols = vec.field("indices").flatten().to_numpy(zero_copy_only=False)
    else:
        idx = vec.field("indices")
        cols = np.concatenate([idx[i].values.to_numpy(zero_copy_only=False) if kinds[i] == 0
                               else np.arange(lens[i]) for i in range(n)] or [np.zeros(0, np.int64)])
    return rows, cols.astype(np.int64, copy=False), v


def sparse_matmul(parts, n: int, w: np.ndarray) -> np.ndarray:
    """X @ w for X given by (row, column, value) non-zeros, rows in order."""
    rows, cols, v = parts
    out = np.zeros((n, w.shape[1]))
    if len(v):
        contrib = v[:, None] * w[cols]
        starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
        out[rows[starts]] = np.add.reduceat(contrib, starts, axis=0)
    return out


def vector_matmul(vec: pa.StructArray, w: np.ndarray) -> np.ndarray:
    """Rows of an ML vector column times w, through the non-zeros only."""
    return sparse_matmul(sparse_parts(vec), len(vec), w)


# ----------------------------------------------------------------- W19 / W23
@dataclass
class TextClassifier:
    features: PipelineModel
    mlp: PipelineModel
    labels: list
    layers: list = field(default_factory=list)

    def weights(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per affine layer (W of shape in x out, b of shape out)."""
        flat = np.asarray(self.mlp.stages[-1].weights.toArray())
        out, off = [], 0
        for n_in, n_out in zip(self.layers[:-1], self.layers[1:]):
            w = flat[off:off + n_in * n_out].reshape(n_in, n_out, order="C")
            off += n_in * n_out
            b = flat[off:off + n_out]
            off += n_out
            out.append((w, b))
        return out

    def history(self) -> list[dict]:
        """Training history: the optimiser's objective (loss) per iteration."""
        mlp = self.mlp.stages[-1]
        # a loaded model carries no training summary
        objective = list(mlp.summary().objectiveHistory) if mlp.hasSummary else []
        return [{"iteration": i, "loss": float(v)} for i, v in enumerate(objective)]

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        self.mlp.write().overwrite().save(f"{path}/mlp")
        meta = json.dumps({"labels": self.labels, "layers": self.layers})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextClassifier":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        return TextClassifier(PipelineModel.load(f"{path}/features"), PipelineModel.load(f"{path}/mlp"),
                              meta["labels"], meta["layers"])


def train_classifier(df: DataFrame, text_col: str = "text", label_col: str = "label",
                     dense_size: int = 64, num_dense_layers: int = 2, num_features: int = 4096,
                     max_iter: int = 100, seed: int = 42, fit_rows: int = FIT_ROWS) -> TextClassifier:
    """Fit features + MLP; the label code is the sorted-label position.

    The features are fitted on every row.  The MLP's optimiser holds its rows dense and
    passes over all of them up to ``max_iter`` times, so it sees a sample of about
    ``fit_rows`` of them, drawn by a hash of text, label and ``seed``.  More than
    ``MAX_LABELS`` labels are refused.
    """
    sizes = df.where(F.col(label_col).isNotNull()).agg(
        F.count("*").alias("n"), F.approx_count_distinct(label_col).alias("labels")).first()
    if sizes["labels"] > MAX_LABELS:
        raise ValueError(f"about {sizes['labels']} labels; the output layer takes at most {MAX_LABELS}")
    coded, num_classes = label_codes(df, label_col, "_label_code")
    labels = [r[0] for r in df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
              .orderBy(label_col).collect()]
    feats = fit_text_features(coded, text_col, num_features)
    draw = F.pmod(F.xxhash64(text_col, label_col, F.lit(seed)), F.lit(DRAWS))
    sample = coded.where(draw < int(DRAWS * min(1.0, fit_rows / max(sizes["n"], 1))))
    x = text_features(feats, sample, text_col).withColumn("_label_code", F.col("_label_code").cast("double"))
    layers = [num_features] + [dense_size] * num_dense_layers + [num_classes]
    mlp = MultilayerPerceptronClassifier(layers=layers, featuresCol="_features", labelCol="_label_code",
                                         maxIter=max_iter, seed=seed, blockSize=128,
                                         predictionCol="_pred", probabilityCol="probability",
                                         rawPredictionCol="_raw")
    model = Pipeline(stages=[mlp]).fit(x)
    return TextClassifier(feats, model, labels, layers)


def validation_accuracy(model: TextClassifier, df: DataFrame, text_col: str = "text",
                        label_col: str = "label", id_col: str = "doc_id") -> float:
    """Share of rows whose predicted label equals the true label (one aggregate)."""
    pred = predict(model, df.select(id_col, text_col), text_col, id_col)
    joined = pred.join(df.select(id_col, label_col), id_col)
    row = joined.agg(F.avg((F.col("predicted") == F.col(label_col).cast("string")).cast("double")).alias("a")).first()
    return float(row["a"]) if row and row["a"] is not None else float("nan")


def predict(model: TextClassifier, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, predicted label, probability array<double>)."""
    x = text_features(model.features, df.select(id_col, text_col), text_col)
    out = model.mlp.transform(x)
    lab = F.array(*[F.lit(v) for v in model.labels])
    from pyspark.ml.functions import vector_to_array
    return out.select(id_col, F.element_at(lab, F.col("_pred").cast("int") + 1).alias("predicted"),
                      vector_to_array("probability").alias("probability"))


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _embedder(bw, id_col: str, batch_size: int):
    def embed(batches):
        layers = bw.value
        for rb in batches:
            n = rb.num_rows
            for s in range(0, n, batch_size):
                part = rb.slice(s, batch_size)
                w0, b0 = layers[0]
                h = vector_matmul(part.column("_features"), w0) + b0
                for w, b in layers[1:]:
                    h = _sigmoid(h) @ w + b
                emb = pa.array(list(h.astype(np.float32)), type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(id_col), emb], names=[id_col, "embedding"])
    return embed


def batch_embeddings(model: TextClassifier, df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     batch_size: int = 128) -> DataFrame:
    """(id, embedding array<float>[dense_size]) = last hidden layer before its activation."""
    hidden = model.weights()[:-1]  # drop the output layer
    bw = df.sparkSession.sparkContext.broadcast(hidden)
    x = text_features(model.features, df.select(id_col, text_col), text_col).select(id_col, "_features")
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, embedding array<float>"
    return x.mapInArrow(_embedder(bw, id_col, batch_size), schema)



def embed_with_function(df: DataFrame, encoder, text_col: str = "text", id_col: str = "doc_id",
                        dim: int | None = None, batch_size: int = 128) -> DataFrame:
    """W23 with a user encoder: ``encoder(list[str]) -> np.ndarray (n, dim)`` runs on
    executors over chunks of ``batch_size`` texts; returns (id, embedding array<float>)."""
    def run(batches):
        for rb in batches:
            texts = rb.column(text_col).to_pylist()
            for s in range(0, len(texts), batch_size):
                vecs = np.asarray(encoder(texts[s:s + batch_size]), dtype=np.float32)
                if dim is not None and vecs.shape[1] != dim:
                    raise ValueError(f"encoder returned width {vecs.shape[1]}, expected {dim}")
                yield pa.RecordBatch.from_arrays(
                    [rb.column(id_col).slice(s, batch_size), pa.array(list(vecs), type=pa.list_(pa.float32()))],
                    names=[id_col, "embedding"])
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, embedding array<float>"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def hashed_embeddings(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", dim: int = 64) -> DataFrame:
    """(id, embedding): counts of the whole text's words in ``dim`` buckets by md5, an encoder that needs no fit.

    Texts without words have no row.  Rows that share an id add up.
    """
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % dim
    each = df.select(id_col, F.explode_outer(words(F.col(text_col))).alias("word")).where(F.col("word").isNotNull())
    counts = each.groupBy(id_col, bucket.cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    held = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("held"))   # at most dim entries
    return held.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("held")[i], F.lit(0.0))).alias("embedding"))
