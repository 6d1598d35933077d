"""Exact global row numbers without a single-partition window (P5).

``Window.orderBy(...)`` with no ``partitionBy`` moves every row to one task.
Instead: range-partition on the sort key (the key ends in a unique id, so even
a value held by a third of the rows is cut across partitions), sort inside
each partition, number rows locally, write the result once under the
checkpoint folder (so both uses below read the same rows even after an
executor loss or an AQE re-plan), count rows per partition (one row per
partition, collected: bounded by the partition count) and add the prefix sum
of the counts as a literal array lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.session import materialize


def _parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def global_rank(df: DataFrame, order_cols: list[Column | str], rank_col: str = "rank",
                num_partitions: int | None = None, label: str = "ranked") -> tuple[DataFrame, int]:
    """Return (df with a 0-based ``rank_col`` in ``order_cols`` order, row count).

    ``order_cols`` must define a total order (end with a unique key).
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    pid = F.spark_partition_id()
    ranged = (df.repartitionByRange(_parts(df, num_partitions), *cols)
              .sortWithinPartitions(*cols)
              .withColumn("_pid", pid)
              .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)))
    ranged = materialize(ranged, label)
    counts = dict(ranged.groupBy("_pid").count().collect())
    offsets, run = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(run)
        run += counts.get(p, 0)
    if not offsets:
        return ranged.drop("_pid", "_local").withColumn(rank_col, F.lit(0).cast("long")), 0
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_pid") + 1)
    return ranged.withColumn(rank_col, off + F.col("_local")).drop("_pid", "_local"), run


def kth_key(df: DataFrame, x_col: str, id_col: str, k: int, window_rows: int = 200_000,
            max_iter: int = 12) -> tuple[float, int]:
    """Exact key (x, id) of the row with 0-based rank ``k`` in (x, id) order.

    Reads only the two key columns and moves no rows: each round brackets the
    target rank with ``approxQuantile`` inside the current window, verifies the
    bracket with exact counts, and narrows the window; a value shared by many
    rows (a tie group, e.g. a third of all rows) is resolved by continuing on
    ``id`` inside the group.  Once the window holds at most ``window_rows`` rows
    they are ordered and the answer is read off (a bounded collect).  ``x``
    must not be null or NaN and ``id`` must be unique.
    """
    x, i = F.col(x_col), F.col(id_col)
    keys = df.select(x.cast("double").alias("_x"), i.cast("long").alias("_i"))
    cond = F.lit(True)
    fixed_x = None          # set once the answer is known to lie in one tie group
    below = 0               # rows ordered before the window
    for _ in range(max_iter):
        win = keys.where(cond)
        m = win.count()
        target = k - below
        if not 0 <= target < m:
            raise ValueError(f"rank {k} outside the {below + m} rows")
        if m <= window_rows:
            rows = win.orderBy("_x", "_i").limit(target + 1).collect()
            r = rows[target]
            return float(r["_x"]), int(r["_i"])
        col = "_i" if fixed_x is not None else "_x"
        c = F.col(col)
        f = (target + 0.5) / m
        # a fixed least width: the sketch keeps its size however many rows there are, and large tables take more rounds
        delta = max(window_rows / (4.0 * m), 4e-4)
        a, b = win.approxQuantile(col, [max(0.0, f - delta), min(1.0, f + delta)], delta / 4)
        cnt = win.agg(*[F.sum(F.when(cond_, 1).otherwise(0)).alias(name) for name, cond_ in
                        (("lt_a", c < a), ("le_a", c <= a), ("lt_b", c < b), ("le_b", c <= b))]).collect()[0]
        lt_a, le_a, lt_b, le_b = (int(cnt[n] or 0) for n in ("lt_a", "le_a", "lt_b", "le_b"))
        if lt_a <= target < le_a or lt_b <= target < le_b:
            # the target sits in the tie group of one bracket end: keep only that group
            v, lt = (a, lt_a) if lt_a <= target < le_a else (b, lt_b)
            cond = cond & (c == v)
            if fixed_x is None:
                fixed_x = v           # order by id inside the group from now on
            below += lt
        elif le_a <= target < lt_b:
            cond = cond & (c > a) & (c < b)
            below += le_a
        elif target < lt_a:           # bracket above the target (not expected): keep the lower part
            cond = cond & (c < a)
        else:                         # bracket below the target (not expected): keep the upper part
            cond = cond & (c > b)
            below += le_b
    raise RuntimeError("order statistic did not converge")


def id_order(df: DataFrame, id_col: str) -> Column:
    """The number that orders ids: the id itself when it is an integer, else the
    first 60 bits of its md5 (distinct ids of any type, in a fixed order)."""
    if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(id_col).cast("long")
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("long")


def key_le(x_col: str, i: Column, key: tuple[float, int]) -> Column:
    """(x, id) <= key in lexicographic order; ``i`` is the ``id_order`` of the rows."""
    x = F.col(x_col).cast("double")
    return (x < F.lit(key[0])) | ((x == F.lit(key[0])) & (i <= F.lit(key[1])))


def key_ge(x_col: str, i: Column, key: tuple[float, int]) -> Column:
    """(x, id) >= key in lexicographic order; ``i`` is the ``id_order`` of the rows."""
    x = F.col(x_col).cast("double")
    return (x > F.lit(key[0])) | ((x == F.lit(key[0])) & (i >= F.lit(key[1])))


def key_table(df: DataFrame, x: Column, id_col: str, label: str) -> tuple[DataFrame, int]:
    """Write only (_x, id) once (narrow) so that repeated order-statistic passes
    do not recompute an expensive input; returns (table, row count)."""
    keys = materialize(df.select(x.cast("double").alias("_x"), id_order(df, id_col).alias(id_col)), label)
    return keys, keys.count()
