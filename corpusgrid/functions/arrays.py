"""Array column expressions (higher-order functions, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad_truncate(ids: Column, length: int, pad: int = 0) -> Column:
    """Zero-pad short arrays and cut long ones to exactly ``length`` entries."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def one_hot(code: Column, num_classes: int) -> Column:
    """array<int> of ``num_classes`` with a 1 at ``code`` (null code -> null)."""
    return F.when(code.isNull(), F.lit(None)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda i: (i == code).cast("int")))


def argmax(values: Column) -> Column:
    """0-based index of the largest entry; ties go to the first index."""
    return F.array_position(values, F.array_max(values)) - 1


def squared_norm(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def with_unit_vector(df: DataFrame, vec_col: str, out_col: str, drop_zero: bool = False) -> DataFrame:
    """Add ``out_col`` = vector / L2 norm (array<double>); zero or null vector -> null
    (or, with ``drop_zero``, the row is dropped).

    The norm is its own projection: written inline inside the ``transform``
    lambda it would be re-aggregated for every element (O(d^2) per row).  For
    the same reason rows are dropped by a filter on the norm, never by a
    null test on the result (a pushed-down copy of that test would inline it).
    """
    tmp = f"_norm_{out_col}"
    out = df.withColumn(tmp, F.sqrt(squared_norm(F.col(vec_col))))
    if drop_zero:
        out = out.where(F.col(tmp) > 0)
    return (out.withColumn(out_col, F.when(F.col(tmp) > 0,
                                           F.transform(F.col(vec_col), lambda x: x.cast("double") / F.col(tmp))))
            .drop(tmp))
