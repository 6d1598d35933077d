"""Token counts, token specificity, article specificity.

token score  = ln(count(type, token) / mean count of the distinct tokens of the type)
article score = mean of the token scores of all its mentions (repeats count each
time); a text without mentions gets a null score.

Plan shape (see README, "Plans"):
  mentions -> partial agg -> shuffle(type, token) -> counts        [hot tokens collapse map side]
  counts   -> partial agg -> shuffle(type) -> means                [one row per type]
  counts   ⋈ broadcast(means)                                      [types are a closed label set]
  mentions ⟕ scores on (type, token) -> shuffle(doc_id) -> avg     [AQE: broadcast if small, split skew]
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions.text import DEFAULT_ENTITY_RULES
from corpusgrid.operators.entities import extract_mentions
from corpusgrid.session import materialize


def token_counts(mentions: DataFrame) -> DataFrame:
    """Mentions per (type, token)."""
    return (mentions.where(F.col("token").isNotNull())
            .groupBy("type", "token").agg(F.count(F.lit(1)).alias("count")))


def token_specificity(mentions: DataFrame, closed_types: bool = False) -> DataFrame:
    """(type, token, count, mean_count, score).

    ``closed_types=True`` states that the types come from a fixed label set
    (a rule table: one type per rule), which bounds the per-type mean table,
    so it is broadcast; otherwise the join is left to AQE, which broadcasts it
    after measuring its size at runtime.
    """
    counts = token_counts(mentions)
    means = counts.groupBy("type").agg(F.avg("count").alias("mean_count"))
    means = F.broadcast(means) if closed_types else means
    return (counts.join(means, "type")
            .select("type", "token", "count", "mean_count",
                    F.log(F.col("count") / F.col("mean_count")).alias("score")))


def article_specificity(mentions: DataFrame, token_scores: DataFrame, on_unseen: str = "null") -> DataFrame:
    """(doc_id, n_mentions, score) for every doc present in ``mentions``.

    Pass mentions extracted with ``keep_empty=True`` to get a (null-score) row
    for texts without mentions.  ``token_scores`` may come from other texts (a
    stored score table): a pair it lacks is ignored (``on_unseen='null'``) or
    fails the job (``'error'``).
    """
    scores = token_scores.select("type", "token", "score")
    j = mentions.join(scores, ["type", "token"], "left")
    score = F.col("score")
    if on_unseen == "error":
        # assert_true yields null when the check holds; it sits inside the
        # aggregated value so the optimizer cannot prune it
        ok = F.assert_true(F.col("token").isNull() | score.isNotNull(), F.lit("mention with no token score"))
        score = F.coalesce(ok.cast("double"), score)
    elif on_unseen != "null":
        raise ValueError("on_unseen must be 'null' or 'error'")
    return j.groupBy("doc_id").agg(F.count("token").alias("n_mentions"), F.avg(score).alias("score"))


def specificity_scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                       rules=DEFAULT_ENTITY_RULES, persist_mentions: bool = True) -> DataFrame:
    """Texts -> (doc_id, n_mentions, score): one row per input text.

    The mention table feeds two branches (token statistics and the per-text
    join), so it is written once under the checkpoint folder.
    """
    mentions = extract_mentions(docs, text_col, id_col, rules, keep_empty=True)
    if persist_mentions:
        mentions = materialize(mentions, "mentions")
    # rule tables give one type per rule: the per-type table is bounded
    return article_specificity(mentions, token_specificity(mentions, closed_types=True))


def top_specific(scored: DataFrame, k: int = 20, digits: int = 6, ascending: bool = False) -> DataFrame:
    """Top-k texts by score (rounded to ``digits`` before ranking, ties by doc_id).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: a per-partition
    top-k and one merge, never a full sort.
    """
    s = F.round("score", digits)
    order = s.asc_nulls_last() if ascending else s.desc_nulls_last()
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(order, F.col("doc_id")).limit(k)
