"""W4 materialise-or-reuse, W6 experiment store, W7 projector export."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: projector export format ------------------------------------
TSV_SEP = "\t"
VALUE_FORMAT = "%.18e"   # number format of the embedding TSV
# -----------------------------------------------------------------------------


def fingerprint(config: dict) -> str:
    """Short stable key of a job configuration (the reuse key of W4)."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


# --- committed datasets: versions under one path, one of them current -----------------------
#
# path/version=<builder>/...      what one builder wrote, never changed afterwards
# path/_manifests/<n>.claim        a builder has taken number n
# path/_manifests/<n>.json         {"version", "folder", "config"}: version n is complete
#
# A claim is a file that only one builder can create, so two builders at once get
# numbers of their own; the manifest appears whole, by a rename.  A reader sees a
# finished version or none.  The greatest number with a manifest is the current
# version; a builder that died leaves a claim and a folder that nobody reads.

def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> dict[int, str]:
    """Version number -> manifest file; empty for a path without versions.  Anything but a missing folder raises."""
    jvm, at, fs = _fs(spark, f"{path.rstrip('/')}/_manifests")
    if not fs.exists(at):
        return {}
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(at)]
    return {int(n[:-5]): p for n, p in names if n.endswith(".json") and n[:-5].isdigit()}


def committed(spark: SparkSession, path: str, version: int | None = None) -> tuple[str, int, dict]:
    """(folder, version, config) of the current or a given version; raises FileNotFoundError without one."""
    known = _manifests(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no committed version{'' if version is None else f' {version}'} at {path}")
    version = max(known) if version is None else version
    lines = spark.read.option("wholetext", True).text(known[version]).collect()      # one small file
    what = json.loads(lines[0]["value"])
    return f"{path.rstrip('/')}/{what['folder']}", version, what["config"]


def commit(spark: SparkSession, path: str, write: Callable[[str], None], config: dict | None = None) -> int:
    """Let ``write`` fill a fresh folder under ``path`` and make it the current version; returns its number.

    A builder that fails leaves no manifest, so its folder is never read."""
    base = path.rstrip("/")
    folder = f"version={uuid.uuid4().hex[:12]}"
    write(f"{base}/{folder}")
    jvm, top, fs = _fs(spark, f"{base}/_manifests")
    fs.mkdirs(top)
    Path = jvm.org.apache.hadoop.fs.Path
    version = 0
    while True:
        version = 1 + max([version, *(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(top)
                                      if s.getPath().getName().split(".")[0].isdigit())])
        try:
            if fs.createNewFile(Path(f"{base}/_manifests/{version}.claim")):
                break
        except Exception:  # noqa: BLE001 - another builder took the number between test and creation: the next one
            if not fs.exists(Path(f"{base}/_manifests/{version}.claim")):
                raise
    text = json.dumps({"version": version, "folder": folder, "config": config or {}}, sort_keys=True, default=str)
    draft = Path(f"{base}/_manifests/.{folder}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, Path(f"{base}/_manifests/{version}.json")):
        raise OSError(f"version {version} of {path} could not be committed")
    return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, fingerprint) of every committed version at ``path``."""
    rows = [(v, committed(spark, path, v)) for v in sorted(_manifests(spark, path))]
    return spark.createDataFrame([(v, f.rsplit("/", 1)[1], fingerprint(c)) for v, (f, _, c) in rows], "version int, folder string, fingerprint string")


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the ``keep`` newest versions, manifests first; returns the numbers that went."""
    gone = sorted(_manifests(spark, path))[:-keep] if keep > 0 else []
    for v in gone:
        folder, _, _ = committed(spark, path, v)
        for at in (f"{path.rstrip('/')}/_manifests/{v}.json", folder):   # its claim stays: numbers are not used again
            _, p, fs = _fs(spark, at)
            fs.delete(p, True)
    return gone


def materialize_or_reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                         partition_by: list[str] | None = None, config: dict | None = None) -> DataFrame:
    """Read the dataset that is current at ``path`` if there is one, else build and commit it.

    With ``config`` a version counts only if it was built with the same one: a
    changed configuration makes a new version.  Only a path without a committed
    version means "build"; a manifest or dataset that cannot be read raises.  Two
    builders at once commit a version each, and either's readers get a whole one.
    """
    key = fingerprint(config or {})
    for version in sorted(_manifests(spark, path), reverse=True):
        folder, _, known = committed(spark, path, version)
        if fingerprint(known) == key:
            return spark.read.parquet(folder)

    def write(folder: str) -> None:
        w = build().write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(folder)

    version = commit(spark, path, write, config)
    return spark.read.parquet(committed(spark, path, version)[0])


def write_experiment(base: str, tables: dict[str, DataFrame], split_col: str = "split",
                     history: list[dict] | None = None) -> dict[str, str]:
    """Each table as parquet under ``base/<name>``, partitioned by split when
    the table has that column; the training history as a small JSON table."""
    paths = {}
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        w = df.write.mode("overwrite")
        if split_col in df.columns:
            w = w.partitionBy(split_col)
        paths[name] = f"{base.rstrip('/')}/{name}"
        w.parquet(paths[name])
    if history is not None and spark is not None:
        paths["history"] = f"{base.rstrip('/')}/history"
        spark.createDataFrame(history).coalesce(1).write.mode("overwrite").json(paths["history"])
    return paths


def projector_rows(df: DataFrame, vec_col: str, text_col: str, label_col: str,
                   order_col: str) -> tuple[DataFrame, DataFrame]:
    """W7 as DataFrames: (order, line) of the vector TSV and of the label TSV.

    Vector lines: values joined by tabs, no header.  Label lines: running index,
    text, label.  Both carry the same order key so the rows align.
    """
    # the JVM pads its shortest digits with zeros; C formatting prints the exact expansion
    @F.pandas_udf("string")
    def vec_line(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else TSV_SEP.join(VALUE_FORMAT % x for x in v))

    vectors = df.select(F.col(order_col).alias("order"), vec_line(F.col(vec_col).cast("array<double>")).alias("line"))
    labels = df.select(F.col(order_col).alias("order"), F.col(text_col).alias("abstract"),
                       F.col(label_col).alias("label"))
    return vectors, labels


def export_projector(df: DataFrame, base: str, vec_col: str, text_col: str, label_col: str,
                     order_col: str) -> dict[str, str]:
    """Write ``embeddings.tsv`` (no header) and ``embedding_labels.tsv``
    (header, index column) as Spark text/CSV outputs ordered by ``order_col``.

    Rows are range-sorted on the order key, so part files concatenate in order;
    the header is the first row of that order, so it stands in the first part alone.
    """
    vectors, labels = projector_rows(df, vec_col, text_col, label_col, order_col)
    vpath, lpath = f"{base.rstrip('/')}/embeddings.tsv", f"{base.rstrip('/')}/embedding_labels.tsv"
    vectors.orderBy("order").select("line").write.mode("overwrite").text(vpath)
    header = df.sparkSession.range(1).select(F.lit(0).alias("_row"), F.lit(None).cast(labels.schema["order"].dataType).alias("order"),
                                             *[F.lit(x).alias(x) for x in ("abstract", "label")])
    rows = labels.select(F.lit(1).alias("_row"), "order", *[F.col(x).cast("string") for x in ("abstract", "label")])
    (header.unionByName(rows).orderBy("_row", "order").drop("_row")
     .write.mode("overwrite").option("sep", TSV_SEP).option("nullValue", "").csv(lpath))
    return {"embeddings": vpath, "labels": lpath}
