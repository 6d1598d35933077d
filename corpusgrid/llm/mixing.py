"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash.  A source whose target is ``k`` whole passes
plus a rest takes each document ``k`` times, and once more where its hash lies
below a threshold.  The threshold comes from word sums by (source, hash digit):
the first histogram finds the digit in which the rest runs out, the next one
refines that digit only, and so on.  No document is sorted or ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import WORD_CLASS, kept, text_or_empty

#: Bits of each level's digit; 3 levels tell 2^36 hash values apart.
DIGIT_BITS = 12
LEVELS = 3
#: Source statistics are broadcast up to this many sources, joined by shuffle beyond.
BROADCAST_SOURCES = 100_000
WEIGHT_CYCLE = (1, 2, 3)
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS, cycle: tuple = WEIGHT_CYCLE) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    The targets are the water level: with weights w and sizes S they are
    min(c * S, level * w), the level such that they sum to the total.  That is
    what capping and resharing the excess by weight ends in.  Sources are
    ordered by code point, null last; a total of 0 gives targets of 0.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())          # one row per source from here on
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (n % len(cycle) + 1).cast("int"))
    s = s.withColumn("w", weight)
    cap = F.col("source_size") * F.lit(float(max_repeats))
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = (s.withColumn("cap", cap)
         .withColumn("total", F.sum("source_size").over(every))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("w_left", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
         # the level if exactly the sources before this one are capped
         .withColumn("level_here", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
         .withColumn("uncapped", F.col("level_here") * F.col("w") <= F.col("cap")))
    level = F.min(F.when(F.col("uncapped"), F.struct((F.col("cap") / F.col("w")).alias("o"),
                                                     F.col("level_here").alias("v")))).over(every)["v"]
    return (s.withColumn("level", level)
            .withColumn("target", F.when(F.col("level").isNull(), F.col("cap"))
                        .otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))))
            .select("source", "source_size", "target"))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def _digit(level: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 64 - DIGIT_BITS * (level + 1)).bitwiseAND((1 << DIGIT_BITS) - 1)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: int = 42, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document: doc_id, source, size (words), source_size, target and copies (0 to max_repeats).

    Nulls: a null text has size 0, a null source is a source of its own, a null
    id hashes like any other value.  Repeated rows share their hash and are all
    taken or all left.  An empty table gives no rows.  Reruns agree: the hash
    depends on id and seed alone.
    """
    narrow = kept(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                              word_count(text_or_empty(text_col)).alias("size"),
                              F.xxhash64(F.lit(seed), F.lit("mix"), F.col(id_col).cast("long")).alias("h")), "mix-sizes")
    plan = (source_targets(narrow.select("source", "size"), max_repeats)
            .withColumn("passes", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.floor(F.col("target") / F.col("source_size"))))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
            .withColumn("prefix", F.lit(0).cast("long")))
    plan = kept(plan, "mix-plan")
    for level in range(LEVELS):
        # only documents whose leading digits equal the source's threshold so far
        held = narrow.withColumn("lead", F.shiftrightunsigned(F.col("h"), 64 - DIGIT_BITS * level) if level else F.lit(0).cast("long"))
        edge = (held.join(_bounded(plan.select(F.col("source").alias("s2"), "prefix", "rest")),
                          F.col("source").eqNullSafe(F.col("s2")) & (F.col("lead") == F.col("prefix")))
                .withColumn("digit", _digit(level))
                .groupBy("source", "rest", "digit").agg(F.sum("size").alias("mass")))
        run = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.withColumn("before", F.coalesce(F.sum("mass").over(run), F.lit(0)))
        # the digit in which the rest is used up: the last one that starts at or below it
        cut = (edge.where(F.col("before") <= F.col("rest")).groupBy("source")
               .agg(F.max(F.struct("digit", "before", "mass")).alias("cut")).withColumnRenamed("source", "s2"))
        plan = kept(plan.join(_bounded(cut), F.col("source").eqNullSafe(F.col("s2")), "left")
                    .withColumn("rest", F.col("rest") - F.coalesce(F.col("cut.before"), F.lit(0)))
                    .withColumn("prefix", F.shiftleft("prefix", DIGIT_BITS) + F.coalesce(F.col("cut.digit"), F.lit(0)))
                    # at the finest digit the document on the edge goes where it leaves the smaller error
                    .withColumn("prefix", F.col("prefix") + (F.lit(level == LEVELS - 1) & (2 * F.col("rest") > F.col("cut.mass"))).eqNullSafe(True).cast("long"))
                    .drop("s2", "cut"), f"mix-plan{level}")
    lead = F.shiftrightunsigned(F.col("h"), 64 - DIGIT_BITS * LEVELS)
    return (narrow.join(_bounded(plan.withColumnRenamed("source", "s2")), F.col("source").eqNullSafe(F.col("s2")))
            .withColumn("copies", (F.col("passes") + F.when((lead < F.col("prefix")) & (F.col("passes") < max_repeats), 1).otherwise(0)).cast("int"))
            .select("doc_id", "source", "size", "source_size", "target", "copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed documents themselves: each row as often as the plan takes it.

    Ids that stand in several rows (or none) keep every one of their rows.
    """
    plan = (mix_plan(docs, id_col, **options).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"))
            .agg(F.max("copies").alias("__copies")))
    source_col = options.get("source_col", "source")
    joined = docs.join(plan, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
                       & F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
    again = joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
