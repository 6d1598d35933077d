"""Corpus pipeline: quality rules, line dedup, near-duplicate join, source mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs.  ``run`` applies them to the table documents of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.llm import line_dedup, mixing, ngram_join, packing, quality
from corpusgrid.llm.common import kept, ready
from corpusgrid.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep; the trusted ids come from labels.

    Null and empty texts have too few words and go.  Rows are judged by themselves: of repeated rows all stay or
    none, null ids too.  An empty table stays empty.  Columns of ``docs`` come back as they were, whatever their names.
    """
    ready(spark)
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    verdict = quality.quality(docs, trusted)
    return verdict.where("kept").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text.

    All rows stay, those whose text is null or empty (and becomes empty) too; rows without an id come after all
    others.  Rows that share an id are one document here and keep the same lines.  An empty table stays empty.
    """
    ready(spark)
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays; documents without an id stay.

    Null and empty texts link with nothing and stay.  Rows that share an id stay or go together.  An empty table
    stays empty.
    """
    ready(spark)
    losers = (ngram_join.jaccard_classes(docs).where("doc_id <> component_id")
              .select(F.col("doc_id").alias("__loser")).distinct())
    return docs.join(losers, F.col("doc_id") == F.col("__loser"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    Null and empty texts have size 0 and follow their id's hash; a null source is a source of its own.  Rows that
    share an id and a source are taken alike.  An empty table stays empty.
    """
    ready(spark)
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in the packed sequences.

    A null or empty text is its end id alone; every row, repeated ones too, has pieces of its own.  An empty table
    gives none.
    """
    return packing.packed_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_duplicates),
          ("mixing sources", mix_sources), ("best-fit packing", pack_sequences)]

#: The last stage tokenises, which SQL cannot express; tests hold every stage against a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
