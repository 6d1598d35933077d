"""N-gram Jaccard join as a blocked sparse product of the document by shingle incidence.

Rows of the incidence are distinct shingle sets (equal sets are one row).
Shingle frequencies come back to the blocks as one small code per shingle.
With shingles ordered rarest first, a pair that reaches the threshold must meet
in the first n - ceil(t n) + 1 of either set: columns of one document drop out,
and a row whose leading part has no shared column cannot link at all.  The
product runs over the remaining columns; pairs below the size-derived bounds
are discarded, the others get their exact overlap.  Copies of a thousand-fold
family are not multiplied out: each column first pairs its rows with one hub
row, and only rows that are still in different classes meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm import buckets as B
from corpusgrid.llm.common import Block, hashed_words, kept, mix, shuffle_partitions, text_blocks
from corpusgrid.llm.components import components

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 75
HUB_ROUNDS = 2
_COEFFICIENTS = np.random.default_rng(55).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: Block, only: np.ndarray | None = None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles of a block's texts, ordered by both."""
    start, _, h = hashed_words(block.text, lower=True)
    doc = np.searchsorted(block.ends, start)
    n = np.bincount(doc, minlength=len(block.ends))
    last = np.cumsum(n)[doc]                                  # end of the own text's words
    x = np.zeros(len(h), np.uint64)
    at = np.arange(len(h))
    for k in range(size):
        inside = at + k < last
        x[inside] += h[at[inside] + k] * _COEFFICIENTS[k]
    whole = n[doc]
    x += np.minimum(whole, size).astype(np.uint64) * _COEFFICIENTS[7]
    first = last - whole
    full = np.where(whole >= size, at + size <= last, at == first)
    if only is not None:
        chosen = np.zeros(len(block.ends), bool)
        chosen[only] = True
        full &= chosen[doc]
    x, doc = mix(x[full]), doc[full].astype(np.uint32)
    order = np.argsort(x)
    order = order[np.argsort(doc[order], kind="stable")]
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return doc[new].astype(np.int64), x[new]


def _sums(doc: np.ndarray, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(x ^ _COEFFICIENTS[seed]))])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return (total[edge[1:]] - total[edge[:-1]]).view(np.int64)


def set_signatures(blocks: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per text: block, ordinal, doc_id, n (set size) and a 128-bit signature of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, ends, text in B.rows_of(batches, "block", "ids", "ends", "text"):
            b = Block(ids, ends, text)
            doc, x = shingle_sets(b, size=size)
            n = len(b.ids)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number] * n, pa.int64()), "ordinal": pa.array(np.arange(n, dtype=np.int32)), "doc_id": pa.array(b.ids),
                "n": pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                "s1": pa.array(_sums(doc, x, n, 5)), "s2": pa.array(_sums(doc, x, n, 6))})
    return blocks.select("block", "ids", "ends", "text").mapInArrow(
        run, "block long, ordinal int, doc_id long, n long, s1 long, s2 long")


def _frequencies(blocks: DataFrame, chosen: DataFrame, n_buckets: int, size: int) -> DataFrame:
    """Answers (block, bucket, codes): 0 for a shingle of one set, else a rising code of its frequency."""
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, ends, text, only in B.rows_of(batches, "block", "ids", "ends", "text", "only"):
            _, x = shingle_sets(Block(ids, ends, text), np.array(only, np.int64), size)
            keys, count = np.unique(B.bucket_keys(x, n_buckets), return_counts=True)
            yield B.send(number, keys, np.minimum(count, 255).astype(np.uint8))

    def meet(table: pa.Table) -> pa.Table:
        keys, ends = B.received(table)
        each = np.frombuffer(b"".join(table.column("extra").to_pylist()), np.uint8).astype(np.int64)
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=each[order])
        codes = np.empty(len(keys), np.uint8)
        codes[order] = np.where(total < 2, 0, np.minimum(255, 1 + 8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[group]
        return B.answers(table, codes, ends)

    sent = blocks.join(chosen, "block").select("block", "ids", "ends", "text", "only").mapInArrow(ship, B.SENT)
    return kept(sent.groupBy("bucket").applyInArrow(meet, B.ANSWER), "frequencies")


ROWS = "doc_id long, n long, prefix int, grams array<long>"


def _incidence(blocks: DataFrame, chosen: DataFrame, codes: DataFrame, n_buckets: int, size: int, percent: int) -> DataFrame:
    """Rows that can link: the shared shingles of a set, rarest first, and how many of them lead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, ends, text, only, got in B.rows_of(batches, "block", "ids", "ends", "text", "only", "got"):
            b = Block(ids, ends, text)
            doc, x = shingle_sets(b, np.array(only, np.int64), size)
            keys, back = np.unique(B.bucket_keys(x, n_buckets), return_inverse=True)
            code = B.answered(keys, [g["bucket"] for g in got or []], [g["bits"] for g in got or []], np.uint8)[back]
            n = np.bincount(doc, minlength=len(b.ids)).astype(np.int64)
            shared = np.bincount(doc[code > 0], minlength=len(b.ids)).astype(np.int64)
            need = -(-n * percent // 100)
            able = (shared >= need) & (n > 0)
            take = able[doc] & (code > 0)
            doc, x, code = doc[take], x[take].view(np.int64), code[take]
            order = np.lexsort((x, code, doc))
            doc, x = doc[order], x[order]
            rows = np.flatnonzero(able)
            offsets = np.concatenate([[0], np.cumsum(shared[rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(b.ids[rows]), pa.array(n[rows]), pa.array((shared - need + 1)[rows].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["doc_id", "n", "prefix", "grams"])

    got = codes.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("got"))
    return (blocks.join(chosen, "block").join(got, "block", "left")
            .select("block", "ids", "ends", "text", "only", "got").mapInArrow(run, ROWS))


def _sizes_fit(percent: int):
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    return small * 100 >= large * percent


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = rows.select(F.col("doc_id").alias("a"), F.col("n").alias("xn"), F.col("grams").alias("xg"))
    right = rows.select(F.col("doc_id").alias("b"), F.col("n").alias("yn"), F.col("grams").alias("yg"))
    both = pairs.join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("xg", "yg")).cast("long")
    return (both.withColumn("overlap", overlap)
            .where(F.col("overlap") * 100 >= (F.col("xn") + F.col("yn") - F.col("overlap")) * percent).select("a", "b"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id (smallest id reachable over links).

    Texts without words (null and empty ones too) have no shingles and link with
    nothing.  Rows with the same id and set are one document.  A null id orders
    after all others and stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = text_blocks(docs, id_col, text_col)
    texts = kept(set_signatures(blocks, size), "sets")
    sets = kept(texts.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "block", "ordinal")).alias("r"))
                .select("s1", "s2", "n", "r.*"), "rows")
    chosen = kept(sets.groupBy("block").agg(F.collect_list("ordinal").alias("only")), "chosen")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_buckets = B.bucket_count(total, shuffle_partitions(spark))
    codes = _frequencies(blocks, chosen, n_buckets, size)
    rows = kept(_incidence(blocks, chosen, codes, n_buckets, size, percent), "incidence")

    # columns of the product: (shingle, row), with the row's size and the share of columns it has left out
    columns = kept(rows.select("doc_id", "n", ((F.col("n") - F.size("grams")) / F.col("n")).alias("own"), "prefix", "grams")
                   .select("doc_id", "n", "own", (F.col("n") - F.size("grams")).alias("u"),
                           F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("pos", "g")), "columns")
    links = spark.createDataFrame([], "a long, b long")
    live = columns
    for turn in range(HUB_ROUNDS):
        # turn 0: the row with the fewest shingles of its own is the likeliest centre of a family
        rank = F.struct("own" if turn == 0 else F.xxhash64(F.lit(turn), "doc_id").alias("own"), "doc_id", "n")
        hub = live.groupBy("g").agg(F.min(rank).alias("hub"))
        pairs = (live.join(hub, "g").where(F.col("doc_id") != F.col("hub.doc_id"))
                 .select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"),
                         F.col("n").alias("na"), F.col("hub.n").alias("nb")).where(_sizes_fit(percent)).select("a", "b").distinct())
        links = kept(links.unionByName(_linked(pairs, rows, percent)), "linked")
        classes = components(links)
        # columns that still hold rows of different classes
        marked = (columns.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                  .withColumn("class", F.coalesce("component", "doc_id")).drop("component"))
        mixed = marked.groupBy("g").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1").select("g")
        live = kept(marked.join(mixed, "g"), "live")
    left = live.select("g", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("class").alias("ca"), (F.col("u") + F.col("pos")).alias("pa"))
    right = live.select("g", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("class").alias("cb"), (F.col("u") + F.col("pos")).alias("pb"))
    bound = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))       # overlap from this column on
    rest = (left.join(right, "g").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _sizes_fit(percent)
                                        & (bound * (100 + percent) >= (F.col("na") + F.col("nb")) * percent))
            .select("a", "b").distinct())
    final = components(links.unionByName(_linked(rest, rows, percent)))
    of_set = sets.select("s1", "s2", "n", F.col("doc_id").alias("node")).join(final, "node", "left").select(
        "s1", "s2", "n", F.coalesce("component", "node").alias("component_id"))
    out = texts.join(of_set, ["s1", "s2", "n"], "left")
    last = F.lit(int(np.iinfo(np.int64).max))
    return out.select(F.nullif("doc_id", last).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.nullif(F.coalesce("component_id", "doc_id"), last).alias("component_id"))
