"""The ingest keeps neither a batch's copy nor the files it has read, and lands its pages compressed."""

import glob

import pytest

from corpusgrid.plans import catalog
from corpusgrid.session import checkpoint_root, drop_folder
from corpusgrid.streaming import ingest


@pytest.fixture()
def table(spark, tmp_dir):
    rows = [(i, f"text {i} of words", "en", f"src{i % 4}", 100 + i) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_dir}/sf/documents.parquet")
    return f"{tmp_dir}/sf"


def _folders(spark, label):
    return set(glob.glob(checkpoint_root(spark).split("://", 1)[-1].removeprefix("file:") + f"/{label}-*"))


def test_landed_copies_hold_the_same_pages_compressed(spark, tmp_dir, table):
    catalog._land(spark, table, f"{tmp_dir}/once")
    catalog._land(spark, table, f"{tmp_dir}/thrice", copies=3)
    assert glob.glob(f"{tmp_dir}/once/*/*/part-*") and all(f.endswith(".gz") for f in glob.glob(f"{tmp_dir}/*/*/*/part-*"))
    pages = lambda p: sorted(map(tuple, spark.read.text(f"{tmp_dir}/{p}").select("year", "month", "value").collect()))
    ids = lambda rows: sorted(x for r in rows for x in r[2].split('"_id":"')[1:])
    once, thrice = pages("once"), pages("thrice")
    assert len(thrice) == 3 * len(once) and len(ids(thrice)) == 3 * len(ids(once))


def test_a_batch_drops_its_copy_and_its_files(spark, tmp_dir, table):
    catalog._land(spark, table, f"{tmp_dir}/src", copies=2)
    before, files = _folders(spark, "ingest_batch"), glob.glob(f"{tmp_dir}/src/*/*/part-*")
    q = ingest.start_ingest(spark, f"{tmp_dir}/src", f"{tmp_dir}/target", f"{tmp_dir}/ck", whole_files=False, max_files_per_trigger=2, drop_read=True)
    q.awaitTermination()
    assert _folders(spark, "ingest_batch") == before             # each batch left a copy of its articles
    assert len(glob.glob(f"{tmp_dir}/src/*/*/part-*")) < len(files)      # those of the last batch may stay
    got = spark.read.parquet(f"{tmp_dir}/target")
    assert got.count() == got.select("id").distinct().count() == 150     # src3 has no abstract key


def test_only_the_checkpoint_root_is_deleted_from(spark, tmp_dir):
    with pytest.raises(ValueError):
        drop_folder(spark, tmp_dir)
