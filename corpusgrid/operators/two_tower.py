"""W20 pair classifier: does this label belong to this text?

Text features (``HashingTF`` + ``IDF``) and the one-hot label are assembled into
one vector and fitted with Spark ML's multilayer perceptron; its first layer is
the sum of a text part and a label part, and the text part alone embeds a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.operators.models import DRAWS, MAX_LABELS, _counts_column, fit_text_features, text_features, vector_matmul

CHUNK_TEXTS = 128           # texts multiplied at once
#: The optimiser's dense rows are held in blocks of so many; of a larger fit, in blocks of at most BLOCK_BYTES.  An array of 1 MB
#: or a bit more takes two regions of a JVM heap below 4 GB, so that the kept blocks fill twice the memory Spark counts for them.
BLOCK_ROWS, SMALL_FIT, BLOCK_BYTES = 128, 100_000, 400_000


@dataclass
class TwoTower:
    features: PipelineModel
    head: PipelineModel      # label index, one-hot label, assembled vector, perceptron
    num_features: int
    dense_size: int
    valid_loss: float | None = None

    @property
    def perceptron(self):
        return self.head.stages[-1]

    def history(self) -> list[dict]:
        """The optimiser's objective per iteration (none for a loaded model)."""
        if not self.perceptron.hasSummary:
            return []
        return [{"iteration": i, "loss": float(v)} for i, v in enumerate(self.perceptron.summary().objectiveHistory)]

    def text_layer(self) -> tuple[np.ndarray, np.ndarray]:
        """First layer's weights of the text features (features x dense_size) and its bias."""
        flat = np.asarray(self.perceptron.weights.toArray())
        width = self.num_features + len(self.head.stages[0].labels)
        first = flat[:width * self.dense_size].reshape(width, self.dense_size)
        return first[:self.num_features], flat[width * self.dense_size:(width + 1) * self.dense_size]


def block_rows(rows: int, width: int) -> int:
    return BLOCK_ROWS if rows <= SMALL_FIT else max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))


def train_two_tower(pairs: DataFrame, text_col: str = "sentence", label_col: str = "label",
                    target_col: str = "is_positive", dense_size: int = 64, num_features: int = 1024,
                    num_dense_layers: int = 2, max_iter: int = 30, seed: int = 42, fit_rows: int | None = None,
                    valid: DataFrame | None = None) -> TwoTower:
    """Fit on (text, label, 0/1 target).

    The optimiser sees every row; its dense rows lie in memory and on the executors' disks.  Only a caller who names
    ``fit_rows`` gets a sample of that expected size (drawn by a hash of the values and ``seed``).  Rows with a null label
    are left out.  With ``valid`` (same columns)
    the fitted model's cross-entropy on it is kept as ``valid_loss``.  Pairs that carry their word counts
    (``with_term_counts``) have no text cut into words again, neither here nor in :func:`two_tower_scores`.
    """
    rows = pairs.where(F.col(label_col).isNotNull())
    sizes = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(label_col).alias("labels")).first()
    if sizes["labels"] > MAX_LABELS:
        raise ValueError(f"about {sizes['labels']} labels; the first layer takes at most {MAX_LABELS}")
    seen = rows
    if fit_rows is not None:
        draw = F.pmod(F.xxhash64(text_col, label_col, target_col, F.lit(seed)), F.lit(DRAWS))
        seen = rows.where(draw < int(DRAWS * min(1.0, fit_rows / max(sizes["n"], 1))))
    feats = fit_text_features(rows, text_col, num_features)
    index = StringIndexer(inputCol=label_col, outputCol="_code", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
    coded = PipelineModel([index, OneHotEncoder(inputCol="_code", outputCol="_label", dropLast=False).fit(index.transform(rows)),
                           VectorAssembler(inputCols=["_features", "_label"], outputCol="_pair")])
    x = coded.transform(text_features(feats, seen, text_col)).select("_pair", F.col(target_col).cast("double").alias("_y"))
    width = num_features + len(index.labels)
    fitted = Pipeline(stages=[MultilayerPerceptronClassifier(
        layers=[width] + [dense_size] * num_dense_layers + [2], featuresCol="_pair", labelCol="_y", maxIter=max_iter,
        seed=seed, blockSize=block_rows(sizes["n"], width + 2), predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw")]).fit(x)
    model = TwoTower(feats, PipelineModel([*coded.stages, *fitted.stages]), num_features, dense_size)
    if valid is not None:
        p = F.greatest(vector_to_array("_prob")[F.col(target_col).cast("int")], F.lit(1e-12))
        model.valid_loss = (model.head.transform(text_features(feats, valid, text_col))
                            .agg(F.avg(-F.log(p)).alias("loss")).first()["loss"])
    return model


def two_tower_scores(model: TwoTower, df: DataFrame, text_col: str = "sentence", label_col: str = "label",
                     id_col: str = "doc_id") -> DataFrame:
    """(id, label, p_match): probability that the label belongs to the text; unknown labels are left out."""
    counts = [c for c in df.columns if c == _counts_column(text_col, model.num_features)]
    x = text_features(model.features, df.select(id_col, text_col, label_col, *counts), text_col)
    return model.head.transform(x).select(id_col, F.col(label_col).alias("label"),
                                          vector_to_array("_prob")[1].alias("p_match"))


def _embedder(layer, id_col: str):
    def embed(batches):
        weights, bias = layer.value
        # a text's non-zeros times dense_size are held at once: few texts at a time
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_TEXTS):
                rb = batch.slice(at, CHUNK_TEXTS)
                out = vector_matmul(rb.column("_features"), weights) + bias
                yield pa.RecordBatch.from_arrays(
                    [rb.column(id_col), pa.array(list(out.astype(np.float32)), pa.list_(pa.float32()))], names=[id_col, "embedding"])
    return embed


def two_tower_embeddings(model: TwoTower, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """W23 for the pair classifier: the text's part of the first layer, before its activation."""
    layer = df.sparkSession.sparkContext.broadcast(model.text_layer())
    x = text_features(model.features, df.select(id_col, text_col), text_col).select(id_col, "_features")
    return x.mapInArrow(_embedder(layer, id_col), f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>")
