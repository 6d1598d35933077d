"""Session helpers: a session builder for tests/bench and lineage cuts.

The library never builds a session itself; jobs pass one in.  Lineage is cut
by writing parquet into the shared folder named by ``spark.checkpoint.dir``
(never a machine-local temp folder, never ``localCheckpoint``).
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "corpusgrid", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session configured for this library.

    AQE is on so that shuffle partitions are coalesced, skewed join partitions
    are split at runtime, and sort-merge joins whose build side turns out to be
    small are converted to broadcast joins after the size is measured.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("CORPUSGRID_SHUFFLE_PARTITIONS", "16"))
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("CORPUSGRID_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: dict[int, str] = {}


def _workers_import(spark: SparkSession) -> bool:
    """One tiny task: can an executor Python worker import ``corpusgrid`` already?"""
    def probe(batches):
        import importlib.util

        import pyarrow as pa
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"ok": [importlib.util.find_spec("corpusgrid") is not None]})
    try:
        rows = spark.range(1, numPartitions=1).mapInArrow(probe, "ok boolean").collect()
        return bool(rows) and all(r["ok"] for r in rows)
    except Exception:  # noqa: BLE001 - treat any failure as "not importable"
        return False


def ship_package(spark: SparkSession) -> str:
    """Make ``corpusgrid`` importable in executor Python workers (as --py-files does).

    Skipped when a probe task shows the workers can already import it.

    The package is zipped as compiled modules next to the package (or in a
    driver temp folder when that is read-only) and added with ``addPyFile``;
    Spark distributes the archive to every executor.  Done once per SparkContext.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return _SHIPPED[key]
    if _workers_import(spark):
        _SHIPPED[key] = ""          # already importable on the workers (e.g. installed)
        return ""
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    digest = hashlib.sha1(b"".join(open(f, "rb").read() for f in files)).hexdigest()[:12]
    digest += f"-py{sys.version_info[0]}{sys.version_info[1]}"
    out_dir = os.path.join(os.path.dirname(pkg), "build")
    try:
        os.makedirs(out_dir, exist_ok=True)
    except OSError:
        out_dir = tempfile.mkdtemp(prefix="corpusgrid-")
    path = os.path.join(out_dir, f"corpusgrid-{digest}.zip")
    if not os.path.exists(path):
        tmp = f"{path}.{uuid.uuid4().hex}"
        # compiled modules (PyZipFile.writepy): workers import without recompiling
        # the sources; PySpark already requires the same Python on driver and workers
        with zipfile.PyZipFile(tmp, "w", zipfile.ZIP_DEFLATED, optimize=0) as z:
            z.writepy(pkg)
        os.replace(tmp, path)
    try:
        sc.addPyFile(path)
    except Exception:  # noqa: BLE001 - already registered by an earlier call
        pass
    _SHIPPED[key] = path
    return path


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint folder; set one only when the session has none.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; without it a cluster job fails fast.  The local fallback folder is for
    local-mode tests only.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not fallback and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    target = conf or fallback or os.path.join("/tmp", f"corpusgrid-ckpt-{uuid.uuid4().hex[:8]}")
    spark.sparkContext.setCheckpointDir(target)
    return spark.sparkContext.getCheckpointDir() or target


def checkpoint_root(spark: SparkSession) -> str:
    """Folder under the shared checkpoint dir where materialized tables go."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    base = conf or ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/corpusgrid"


def materialized_at(df: DataFrame, label: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """:func:`materialize` with the folder, for a caller that drops it after its last use (:func:`drop_folder`)."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint root and read it back.

    Used where one intermediate feeds two branches of a plan (e.g. the mention
    table feeds both the token counts and the per-article join): the expensive
    producer runs once, the lineage is cut, and a lost executor does not force
    a recompute from the raw text.
    """
    return materialized_at(df, label)[0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What runs in here leaves no shuffle files behind: they go when its write or collect has ended, not with the driver's garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written under the checkpoint root; any other path is refused."""
    if not path.startswith(f"{checkpoint_root(spark)}/"):
        raise ValueError(f"not under the checkpoint root: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
