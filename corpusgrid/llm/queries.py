"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.llm import exact_dedup, license_scan, line_dedup, mixing, ngram_join, packing, pii, quality, suffix_dedup, token_alignment, token_codec, toxicity, whitening
from corpusgrid.llm.common import ready, text_or_empty


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("text").cast("binary"), 256).alias("kept_sha256"))


#: Key of the registered query only; a real run passes its own secret.
PII_KEY = "registered-query"


def op3_pii(spark, sf_dir):
    """doc_id, counts by kind and the pseudonymised whole text of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


def op4_token_output(spark, sf_dir):
    path = token_codec.files_path(spark, "token-files")
    token_codec.write_tokens(_table(spark, sf_dir, "documents"), path)
    out = token_codec.read_tokens(spark, path)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


TOXIC_FROM = 0.7


def op8_toxicity(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
                      F.size("spans").cast("long").alias("n_spans"))


def op9_mixing(spark, sf_dir):
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_quality_rules(spark, sf_dir):
    trusted = quality.trusted_ids(_table(spark, sf_dir, "labels"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark, sf_dir):
    """Tokens, groups and links of two public vocabularies over every whole text."""
    return token_alignment.align(_table(spark, sf_dir, "documents"))


def op13_license_scans(spark, sf_dir):
    out = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_line_dedup, op3_pii, op4_token_output, op5_ngram_jaccard_join, op6_best_fit_packing, op7_exact_dedup, op8_toxicity, op9_mixing, op10_quality_rules, op11_embedding_whitening,
                                  op12_token_alignment, op13_license_scans)}
