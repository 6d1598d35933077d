"""W5 scored scan, W16 sampling, W14 random split, W13 specificity-tail split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions.draws import hash_number
from corpusgrid.operators.ranking import id_order, key_ge, key_le, key_table, kth_key
from corpusgrid.session import materialize


def scored_scan(df: DataFrame, score_col: str = "score", id_col: str | None = "doc_id",
                subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null/NaN score, drop exact duplicates, sort by score.

    Duplicates are rows equal in every column; with ``subset``, rows equal in
    those columns, of which the one with the smallest ``id_col`` survives
    (``dropDuplicates`` would keep an arbitrary row).  Both pre-aggregate map
    side.  Sort ties are broken by the id.
    """
    kept = df.where(F.col(score_col).isNotNull() & ~F.isnan(F.col(score_col)))
    if not subset:
        out = kept.distinct()
    elif id_col is None:
        out = kept.dropDuplicates(subset)
    else:
        rest = [c for c in df.columns if c != id_col and c not in subset]
        out = (kept.groupBy(*subset).agg(F.min(F.struct(id_col, *rest)).alias("_r"))
               .select(*[F.col(f"_r.{c}").alias(c) if c not in subset else F.col(c) for c in df.columns]))
    return out.orderBy(*[F.col(c) for c in (score_col, id_col) if c])


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Exactly min(n, rows) rows without replacement, reproducible.

    Rows are ordered by a seeded 48-bit hash of the id (ties by id) and the first
    n kept: the exact cut key is found with ``kth_key`` on the written (hash, id)
    columns and the sample is a narrow filter, for every n and any type of id.
    """
    h = hash_number(F.col(id_col), "sample", seed)
    if n <= 0:
        return df.limit(0)
    keys, total = key_table(df, h, id_col, "sample_keys")
    if n >= total:
        return df
    cut = kth_key(keys, "_x", id_col, n - 1)
    return df.withColumn("_h", h).where(key_le("_h", id_order(df, id_col), cut)).drop("_h")


def split_random(df: DataFrame, test_fraction: float = 0.25, seed: int = 42,
                 id_col: str = "doc_id", split_col: str = "split") -> DataFrame:
    """Exact split, ceil(test_fraction * n) rows in 'test', rest in 'train'.

    The permutation is a seeded 48-bit hash of the id (ids must be unique).  The
    cut is the exact key of rank n_test - 1, found by ``kth_key`` on the written
    (hash, id) columns alone; the split itself is then a narrow projection --
    no shuffle and no rewrite of the table.
    """
    h = hash_number(F.col(id_col), "split", seed)
    keys, n = key_table(df, h, id_col, "split_keys")
    n_test = math.ceil(test_fraction * n)
    if n_test <= 0:
        return df.withColumn(split_col, F.lit("train"))
    cut = kth_key(keys, "_x", id_col, n_test - 1)
    return (df.withColumn("_h", h)
            .withColumn(split_col, F.when(key_le("_h", id_order(df, id_col), cut), "test").otherwise("train")).drop("_h"))


def split_tail(df: DataFrame, score_col: str = "score", cutoff: float = 0.5, train_tail: bool = False,
               id_col: str = "doc_id", split_col: str = "split") -> DataFrame:
    """c = int(cutoff * n) over rows in ascending (score, id) order (ids that
    are no integers: in the order of ``ranking.id_order``).

    'train' = the c highest-scored rows, 'test' = the c lowest (``train_tail``
    swaps the names).  For cutoff < 0.5 the middle rows are in neither part;
    for cutoff > 0.5 rows in the overlap appear once per part.  A cutoff that
    gives c = 0 is rejected.  Rows need a non-null, non-NaN score (``scored_scan``).
    The input is written once: cut keys and split read the same rows, so a score
    that another layout sums to other last bits cannot fall between them.
    """
    df = materialize(df, "tail_rows")
    keys, n = key_table(df, F.col(score_col), id_col, "tail_keys")
    c = int(cutoff * n)
    if c <= 0 or cutoff > 1:
        raise ValueError(f"cutoff {cutoff} gives {c} rows of {n}; need 0 < int(cutoff*n) and cutoff <= 1")
    low_cut = kth_key(keys, "_x", id_col, c - 1)        # last row of the bottom c
    high_cut = kth_key(keys, "_x", id_col, n - c)       # first row of the top c
    in_bottom = key_le(score_col, id_order(df, id_col), low_cut)
    in_top = key_ge(score_col, id_order(df, id_col), high_cut)
    top, bottom = ("test", "train") if train_tail else ("train", "test")
    parts = F.array_compact(F.array(F.when(in_top, F.lit(top)), F.when(in_bottom, F.lit(bottom))))
    return df.withColumn(split_col, F.explode(parts))
