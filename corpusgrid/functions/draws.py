"""Reproducible pseudo-random numbers as column expressions.

A draw is the first 48 bits of ``md5(seed ':' salt ':' key)`` read as a
non-negative bigint.  It depends only on the key, never on partitioning or
task retries, so a recomputed partition after an executor loss yields the
same numbers; the same value is computable in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(key: Column, salt: str, seed: int | str = 42) -> Column:
    """Uniform integer in [0, 2^48) from ``key`` (cast to string)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
