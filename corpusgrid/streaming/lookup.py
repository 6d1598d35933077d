"""Nearest-neighbour lookups for vectors or texts arriving as a stream.

Each micro-batch of queries is answered against a corpus; the answer of batch
``n`` is written to ``sink/batch_id=n`` with overwrite, so a re-run batch
replaces its own output (exactly once).  With ``index`` the corpus is a stored
vector index: its cells are read, not built, in each batch, and a version
committed meanwhile is used from the next batch on.  ``embed`` turns arriving
texts into vectors, ``texts`` gives the neighbours' texts back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusgrid.operators.joins import broadcast_if_small
from corpusgrid.operators.vector_index import open_index, search_index
from corpusgrid.operators.vectors import nearest_neighbors
from corpusgrid.session import materialize


def answer(batch: DataFrame, corpus: DataFrame | None, k: int = 10, query_id: str = "query_id", corpus_id: str = "doc_id",
           query_vec: str = "embedding", corpus_vec: str = "embedding", index: str | None = None, probes: int | None = 8,
           texts: DataFrame | None = None, text_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, neighbor_id, similarity, and with ``texts`` the neighbour's text) of one batch."""
    if index is not None:
        found = search_index(batch, open_index(batch.sparkSession, index), k, probes, query_id, query_vec)
    else:
        found = nearest_neighbors(batch, corpus, k, query_id, corpus_id, query_vec, corpus_vec)
    if texts is None:
        return found
    # k rows for each query of the batch: the batch's side is broadcast when a count shows it is small
    found = broadcast_if_small(materialize(found, "lookup_found"))
    wanted = texts.withColumnsRenamed({text_id: "neighbor_id", text_col: "text"}).select("neighbor_id", "text")
    return wanted.join(found, "neighbor_id").select("query_id", "rank", "neighbor_id", "similarity", "text")


def start_lookup(spark: SparkSession, queries: DataFrame, corpus: DataFrame | None, sink: str, checkpoint: str,
                 k: int = 10, query_id: str = "query_id", corpus_id: str = "doc_id",
                 query_vec: str = "embedding", corpus_vec: str = "embedding",
                 available_now: bool = True, embed: Callable[[DataFrame], DataFrame] | None = None, index: str | None = None,
                 probes: int | None = 8, texts: DataFrame | None = None, text_id: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """``embed``: optional ``DataFrame -> DataFrame`` applied to each micro-batch
    first (e.g. ``lambda b: batch_embeddings(model, b, id_col='query_id')`` for
    arriving texts), so the stream can carry texts instead of vectors."""
    def each(batch: DataFrame, batch_id: int) -> None:
        if embed is not None:
            batch = embed(batch)
        out = answer(batch, corpus, k, query_id, corpus_id, query_vec, corpus_vec, index, probes, texts, text_id, text_col)
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    w = queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
