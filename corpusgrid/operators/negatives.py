"""W15 negative (text, wrong label) pairs and W17 two-tower training pairs.

Semantics: repeatedly draw an entity type with probability proportional to its
number of distinct texts, draw two distinct texts of that type uniformly, skip
a pair seen before, and when the two labels differ emit both texts with the
labels swapped -- until int(ratio * n) rows (n counts every text, also those
without entities); an odd target cuts the last pair to its first row.

Plan (no per-type self-join, which is quadratic in a hot type):

* incidence ``(type, doc_id)`` (distinct) gets a dense global index ``g`` in
  (type, doc_id) order via range partitioning (``global_rank``), so picking a
  uniform ``g`` picks a type proportionally to its size *and* a text inside it;
* draw ``k`` in ``range(M)`` carries two hash numbers; the first selects ``g``,
  the second the partner position among the other ``n_t - 1`` texts of the type;
  both lookups are equi-joins on ``g`` (uniform keys, no skew);
* the first draw of each unordered pair wins; pairs with equal labels are
  dropped; accepted pairs are numbered by draw and the first ``ceil(target/2)``
  kept.  Draw numbers depend only on ``k`` and the seed, so a larger ``M``
  only appends draws: rounds double ``M`` until enough pairs are accepted or
  three doublings bring no new pair, and then the shortfall is reported
  (``max_rounds`` ends them earlier where a caller asks for it).
"""

from __future__ import annotations

import itertools
import logging
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.functions.draws import hash_number
from corpusgrid.operators.joins import broadcast_if_small
from corpusgrid.operators.ranking import global_rank
from corpusgrid.session import materialize

log = logging.getLogger(__name__)

#: Most entity types of one text whose subsets are counted (a million for each distinct set of types).
MAX_TYPES = 20


def incidence(mentions: DataFrame) -> DataFrame:
    """Distinct (type, doc_id) of texts with at least one mention."""
    return mentions.where(F.col("type").isNotNull()).select("type", "doc_id").distinct()


def type_frequencies(mentions: DataFrame) -> DataFrame:
    """(type, n_texts, frequency): the draw probability of each type."""
    per = incidence(mentions).groupBy("type").agg(F.count(F.lit(1)).alias("n_texts"))
    # one row per type (closed label set), so an unpartitioned window is bounded
    total = F.sum("n_texts").over(Window.partitionBy())
    return per.select("type", "n_texts", (F.col("n_texts") / total).alias("frequency"))


def _indexed_incidence(mentions: DataFrame) -> tuple[DataFrame, int]:
    ranked, n_inc = global_rank(incidence(mentions), ["type", "doc_id"], rank_col="g", label="incidence")
    # one row per entity type: broadcast once a count has shown it is small
    stats = ranked.groupBy("type").agg(F.min("g").alias("t_start"), F.count(F.lit(1)).alias("n_t"))
    stats = broadcast_if_small(stats)
    return ranked.join(stats, "type").select("g", "doc_id", "type", "t_start", "n_t"), n_inc


def _accepted_pairs(spark, inc: DataFrame, n_inc: int, labels: DataFrame, first: int, behind: int, seed) -> DataFrame:
    """(a, b, k, label_a, label_b): the pairs with different labels that draws first <= k < behind hit."""
    k = F.col("id")
    draws = spark.range(first, behind).select(k.alias("k"),
                                  (hash_number(k, "a", seed) % F.lit(n_inc)).alias("g"),
                                  hash_number(k, "b", seed).alias("r2"))
    d1 = (draws.join(inc, "g").where(F.col("n_t") >= 2)
          .select("k", F.col("doc_id").alias("doc1"),
                  (F.col("t_start") + (F.col("g") - F.col("t_start") + 1 + F.col("r2") % (F.col("n_t") - 1))
                   % F.col("n_t")).alias("g2")))
    d2 = d1.join(inc.select(F.col("g").alias("g2"), F.col("doc_id").alias("doc2")), "g2")
    pairs = (d2.groupBy(F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b"))
             .agg(F.min("k").alias("k")))
    la = labels.select(F.col("doc_id").alias("a"), F.col("label").alias("label_a"))
    lb = labels.select(F.col("doc_id").alias("b"), F.col("label").alias("label_b"))
    return pairs.join(la, "a").join(lb, "b").where(F.col("label_a") != F.col("label_b"))


def valid_pairs(mentions: DataFrame, labels: DataFrame) -> int:
    """How many unordered pairs of texts share an entity type and differ in their label (null labels differ from nothing).

    Texts are counted by (set of types, label).  For a set U of types, the texts
    that have all of U make N (N - 1) / 2 pairs, and those of one label among them
    n (n - 1) / 2; summed over all U with alternating signs, a pair that shares
    several types counts once.  The work grows with the distinct sets, not with pairs.
    """
    sets = (incidence(mentions).join(labels.where(F.col("label").isNotNull()), "doc_id")
            .groupBy("doc_id", "label").agg(F.sort_array(F.collect_set("type")).alias("types"))
            .groupBy("types", "label").agg(F.count("*").alias("n")))
    sets = materialize(sets, "type_sets")
    widest = sets.agg(F.max(F.size("types"))).first()[0] or 0
    if widest > MAX_TYPES:
        raise ValueError(f"a text has {widest} entity types; pairs are counted over the subsets of at most {MAX_TYPES}")
    masks = F.explode(F.expr("sequence(1, shiftleft(1, size(types)) - 1)"))
    shared = (sets.select("types", "label", "n", masks.alias("mask"))
              .select(F.filter("types", lambda t, i: F.getbit(F.col("mask"), i) == 1).alias("u"), "label", "n")
              .groupBy("u", "label").agg(F.sum("n").alias("n")))
    pairs = lambda n: n * (n - 1) / 2
    n = F.col("n").cast("decimal(30,0)")
    signed = (shared.groupBy("u").agg(F.sum(n).alias("n"), F.sum(pairs(n)).alias("same"))
              .select((F.when(F.size("u") % 2 == 1, 1).otherwise(-1) * (pairs(F.col("n")) - F.col("same"))).alias("v")))
    return int(signed.agg(F.sum("v")).first()[0] or 0)


def negative_pairs(texts: DataFrame, mentions: DataFrame, ratio: float = 1.0, seed=42,
                   max_rounds: int | None = None, id_col: str = "doc_id", text_col: str = "sentence",
                   label_col: str = "label", return_info: bool = False):
    """(doc_id, sentence, label, source_doc_id, neg_index).

    ``label`` is the label of ``source_doc_id``, the partner text; ``neg_index``
    orders the rows as the sequential process would emit them.
    """
    spark = texts.sparkSession
    t = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("sentence"),
                     F.col(label_col).cast("string").alias("label"))
    n = t.count()
    target = int(ratio * n)
    need = math.ceil(target / 2)
    info = {"texts": n, "target_rows": target, "pairs_needed": need, "draws": 0, "pairs_accepted": 0}
    id_type = t.schema["doc_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"doc_id {id_type}, sentence string, label string, source_doc_id {id_type}, neg_index long")
    if target <= 0:
        return (empty, info) if return_info else empty
    inc, n_inc = _indexed_incidence(mentions)
    if n_inc == 0:
        info["shortfall_rows"] = target
        log.warning("negative pairs: no text has an entity; 0 of %d rows", target)
        return (empty, info) if return_info else empty
    labels = t.select("doc_id", "label")
    done, m = 0, max(64, math.ceil(need * 1.5))
    pairs, got, valid = None, 0, None
    for rnd in itertools.count(1):
        fresh = _accepted_pairs(spark, inc, n_inc, labels, done, m, seed)
        if pairs is not None:                              # a pair keeps its first draw
            fresh = pairs.unionByName(fresh).groupBy("a", "b", "label_a", "label_b").agg(F.min("k").alias("k"))
        pairs = materialize(fresh.select("a", "b", "label_a", "label_b", "k"), "neg_drawn")
        got = pairs.count()
        info.update(draws=m, pairs_accepted=got, rounds=rnd)
        if got >= need or rnd == max_rounds:
            break
        if valid is None and rnd > 1:
            valid = valid_pairs(mentions, labels)
            info["pairs_valid"] = valid
        if valid is not None and got >= valid:
            break
        # as many draws as the rate so far asks for, with some to spare; at least twice, at most 16 times as many
        wanted = need if valid is None else min(need, valid)
        done, m = m, min(16 * m, max(2 * m, math.ceil(1.1 * m * wanted / max(got, 1))))
    ranked, got = global_rank(pairs, ["k"], rank_col="pr", label="neg_pairs")
    kept = ranked.where(F.col("pr") < need)
    rows = kept.select(F.explode(F.array(
        F.struct(F.col("a").alias("doc_id"), F.col("label_b").alias("label"), F.col("b").alias("source_doc_id"),
                 (F.col("pr") * 2).alias("neg_index")),
        F.struct(F.col("b").alias("doc_id"), F.col("label_a").alias("label"), F.col("a").alias("source_doc_id"),
                 (F.col("pr") * 2 + 1).alias("neg_index")))).alias("r")).select("r.*")
    rows = rows.where(F.col("neg_index") < target)
    out = rows.join(t.select("doc_id", "sentence"), "doc_id").select(
        "doc_id", "sentence", "label", "source_doc_id", "neg_index")
    short = max(0, target - 2 * min(info["pairs_accepted"], need))
    if short:
        info["shortfall_rows"] = short
        log.warning("negative pairs: %d of %d rows missing after %d draws",
                    short, target, info["draws"])
    return (out, info) if return_info else out


def two_tower_pairs(texts: DataFrame, negatives: DataFrame, id_col: str = "doc_id",
                    text_col: str = "sentence", label_col: str = "label") -> DataFrame:
    """Positives (own label, target [0,1]) union negatives (target [1,0])."""
    pos = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("sentence"),
                       F.col(label_col).cast("string").alias("label"),
                       F.col(id_col).alias("source_doc_id"), F.lit(1).alias("is_positive"))
    neg = negatives.select("doc_id", "sentence", "label", "source_doc_id", F.lit(0).alias("is_positive"))
    both = pos.unionByName(neg)
    return both.withColumn("target", F.array(1 - F.col("is_positive"), F.col("is_positive")))
