"""Line dedup: a line found in several documents stays only in the one with the smallest id.

Lines become 128-bit key hashes.  (hash, salt) ranges with a secondary sort by
document and position let each task stream the first document of every key;
the first of each salt then meet in a second, much smaller round.  The salt
deals a line that stands in a third of all documents over many tasks.  What
returns to the documents is a run-length keep bitmap, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import SPACE_CHARS, ascii_lower, kept, text_or_empty

MIN_KEY = 10
SALTS = 64


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY,
                 salts: int = SALTS) -> DataFrame:
    """One row per document that loses lines: doc_id, version, dropped (line numbers, ascending) as
    ``keep`` = array of (start, length) runs of kept lines, n_lines and n_dropped.

    ``version`` hashes the text: rows that share an id are one document, and
    each distinct text of it has its own bitmap.  Rows with a null id keep all
    their lines and make no other document lose any.
    """
    text = text_or_empty(text_col)
    lines = (docs.where(F.col(id_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), _lines(text).alias("lines"))
             .select("doc_id", "version", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
             .withColumn("key", line_key(F.col("line")))
             .where(F.char_length("key") >= min_key)
             .select("doc_id", "version", "n_lines", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))
             .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")))
    lines = kept(lines, "line-hashes")

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        stream = Window.partitionBy(*keys).orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
        return (rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "doc_id", "pos")
                .withColumn("first_doc", F.first("doc_id").over(stream)))

    local = kept(first(lines, "h1", "h2", "salt"), "line-firsts")
    later = local.where(F.col("doc_id") > F.col("first_doc"))
    final = first(local.where(F.col("doc_id") == F.col("first_doc")).drop("first_doc"), "h1", "h2")
    cols = ["doc_id", "version", "n_lines", "pos"]
    dropped = later.select(*cols).unionByName(final.where(F.col("doc_id") > F.col("first_doc")).select(*cols))
    gone = (dropped.groupBy("doc_id", "version").agg(F.first("n_lines").alias("n_lines"),
                                                     F.array_sort(F.collect_set("pos")).alias("gone")))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), F.col("gone")), F.concat(F.col("gone"), F.array(F.col("n_lines"))),
                      lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return gone.select("doc_id", "version", "n_lines", F.size("gone").cast("long").alias("n_dropped"),
                       F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text; adds n_lines and n_dropped.  Null texts count as one empty line."""
    b = bitmaps.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("n_dropped").alias("__n"),
                       F.col("keep").alias("__keep"))
    text = text_or_empty(text_col)
    joined = docs.withColumn("__v", F.xxhash64(text)).join(
        b, (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__v") == F.col("__version")), "left")
    parts = _lines(text)
    left = F.array_join(F.flatten(F.transform("__keep", lambda r: F.slice(parts, r["start"] + 1, r["length"]))), "\n")
    return (joined.withColumn("n_lines", F.size(parts).cast("long"))
            .withColumn("n_dropped", F.coalesce(F.col("__n"), F.lit(0)).cast("long"))
            .withColumn(text_col, F.when(F.col("__n").isNull(), F.col(text_col)).otherwise(left))
            .drop("__id", "__version", "__n", "__keep", "__v"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that an earlier document holds; other columns pass through.

    An empty table gives an empty table; null and empty texts stay as they are.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **options), id_col, text_col)
