"""Incremental archive ingest as a Structured Streaming job.

New month files land in a folder; a file-source stream hands each micro-batch
of raw files to ``foreachBatch``, which parses them with the W1 transform,
keeps one row per article id (the smallest row by (path, content), found with a
partially-aggregated ``min`` so a hot duplicated id never sits in one task),
drops ids already in the target and writes the rest.

The target is partitioned by the article's month and by the batch that wrote it.
An id belongs to one month, so only the batch's own months are looked through:
the work of a batch does not grow with the target.  A batch overwrites its own
partitions (dynamic partition overwrite), so a batch that is run again replaces
what it had written, whole or not; back-filled months are accepted (a watermark
would drop them).  ``scope="all"`` looks for ids in every month.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgrid.operators.joins import broadcast_if_small
from corpusgrid.session import drop_folder, materialized_at, shuffles_released
from corpusgrid.sources.archive import ARTICLE_COLUMNS, parse_archive
from corpusgrid.sources.store import fingerprint


def dedupe_articles(articles: DataFrame) -> DataFrame:
    cols = [c for c in articles.columns if c != "id"]
    best = articles.groupBy("id").agg(F.min(F.struct(*cols)).alias("_r"))
    return best.select("id", *[F.col(f"_r.{c}").alias(c) for c in cols])


MONTH = ("year", "month")


def _target(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):    # no target yet
            return None
        raise


def known_ids(target: DataFrame, fresh: DataFrame, batch: str, scope: str = "month") -> DataFrame:
    """Ids of the target that the batch could repeat, from its months' partitions only; its own earlier output is left out."""
    held = target.where(F.col("batch") != batch)
    if scope == "month":
        months = [(r["year"], r["month"]) for r in fresh.select(*MONTH).distinct().collect()]       # the batch's months
        codes = sorted(y * 12 + m for y, m in months if y is not None)
        pick = F.expr(f"year * 12 + month IN ({', '.join(map(str, codes))})") if codes else F.lit(False)    # one flat list of any length
        held = held.where(pick | F.col("year").isNull() if len(codes) < len(months) else pick)
    return held.select("id")


def upsert_batch(spark: SparkSession, raw: DataFrame, target: str, rejects: str | None = None,
                 batch: str | None = None, scope: str = "month") -> None:
    """Parse one batch of raw files and write its unseen articles to ``target`` as the batch's own partitions."""
    batch = batch or uuid.uuid4().hex
    articles, bad = parse_archive(raw, keep=("path",))
    fresh = dedupe_articles(articles.select("path", *ARTICLE_COLUMNS))
    session = fresh.sparkSession                           # a stream's batches have a session of their own
    with shuffles_released(session):
        fresh, folder = materialized_at(fresh.withColumns({"year": F.year("pub_date"), "month": F.month("pub_date")}), "ingest_batch", "zstd")
        held = _target(spark, target)
        if held is not None:
            # probe the months with the batch's ids as the hash-table side (size checked); the ids found are at most the batch's
            batch_ids = broadcast_if_small(fresh.select("id"))
            seen = known_ids(held, fresh, batch, scope).join(batch_ids, "id", "left_semi").distinct()
            fresh = fresh.join(broadcast_if_small(seen), "id", "left_anti")
        # the rows of a month come together: each task writes its own months, not some of every month
        (fresh.withColumn("batch", F.lit(batch)).hint("rebalance", *MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy(*MONTH, "batch").parquet(target))
    drop_folder(session, folder)                           # the target holds its rows now; a repeated batch writes a copy of its own
    if rejects:                                            # a batch that is run again replaces its own rejects
        bad.write.mode("overwrite").parquet(f"{rejects.rstrip('/')}/batch_id={batch}")


def start_ingest(spark: SparkSession, source_dir: str, target: str, checkpoint: str,
                 rejects: str | None = None, whole_files: bool = True, available_now: bool = True,
                 max_files_per_trigger: int | None = None, scope: str = "month", drop_read: bool = False) -> StreamingQuery:
    """Start the stream.  ``whole_files``: one JSON document per file (as the
    archive delivers it); otherwise one JSON document per line.  Batches are
    named after the checkpoint, so streams of their own never replace each other's.
    ``drop_read`` deletes the files of a batch once it is committed."""
    stream = fingerprint({"checkpoint": checkpoint})
    reader = spark.readStream.format("text").option("wholetext", whole_files)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if drop_read:
        reader = reader.option("cleanSource", "delete")
    raw = reader.load(source_dir).select(F.col("_metadata.file_path").alias("path"), "value")

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(spark, batch, target, rejects, f"{stream}-{batch_id}", scope)

    w = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
