"""Entity mentions (doc_id, type, pos, token).

The extractor is a parameter:

* rule table ``[(type, java_regex), ...]`` -> one ``regexp_extract_all`` per rule,
  evaluated in a single projection over the scan (no shuffle);
* gazetteer ``(phrase, type)`` -> word n-grams of each text joined to the
  phrase table (broadcast only when a count bounds it);
* any function ``Iterator[pd.DataFrame] -> Iterator[pd.DataFrame]`` run with
  ``mapInPandas`` (e.g. a statistical recogniser shipped to the executors).

Output is long form, one row per mention; ``pos`` numbers mentions of one type
inside one text.  With ``keep_empty=True`` a text without mentions yields one
row with null type/pos/token, so later per-text aggregates keep every text
without joining back to the text table.
"""

from __future__ import annotations

from typing import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions.text import DEFAULT_ENTITY_RULES, mention_array, words
from corpusgrid.operators.joins import broadcast_if_small

MENTION_COLUMNS = "type string, pos int, token string"


def extract_mentions(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     rules: Iterable[tuple[str, str]] = DEFAULT_ENTITY_RULES,
                     keep_empty: bool = False) -> DataFrame:
    rules = tuple(rules)
    types = [t for t, _ in rules]
    if len(set(types)) != len(types):
        raise ValueError("one pattern per entity type; join alternatives with '|'")
    # inline_outer + a null filter, not inline: for an inner generator the
    # optimizer infers ``size(m) > 0`` and pushes that copy of the whole
    # extraction below the preceding exchange, running the regexes twice
    out = (docs.select(F.col(id_col).alias("doc_id"), mention_array(F.col(text_col), rules).alias("m"))
           .select("doc_id", F.inline_outer("m")))
    return out if keep_empty else out.where(F.col("type").isNotNull())


def extract_with_function(docs: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                          text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Run a user recogniser per Arrow batch; it receives (doc_id, text) frames and
    must yield frames with columns doc_id, type, pos, token."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {MENTION_COLUMNS}"
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(fn, schema))


def extract_gazetteer(docs: DataFrame, gazetteer: DataFrame, max_n: int = 3,
                      text_col: str = "text", id_col: str = "doc_id",
                      broadcast_rows: int = 2_000_000) -> DataFrame:
    """Mentions = word n-grams (n <= max_n, normalised words joined by one space)
    that equal a ``phrase`` of ``gazetteer(phrase, type)``.

    The n-grams of a text are generated in one projection; the phrase table is
    broadcast when a count shows it is small, else the join shuffles on the
    n-gram and AQE splits skewed n-gram partitions.
    """
    w = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    # words are read in place: no slice of the array for each n-gram
    def gram_of(n):
        return lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"),
                                  F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(n)]).alias("gram"))

    grams = [F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n))
                         .otherwise(F.array().cast("array<int>")), gram_of(n))
             for n in range(1, max_n + 1)]
    cand = w.select("doc_id", F.inline_outer(F.concat(*grams))).where(F.col("gram").isNotNull())
    phrases = gazetteer.select(F.col("phrase").alias("gram"), "type").dropDuplicates(["gram", "type"])
    hits = cand.join(broadcast_if_small(phrases, broadcast_rows), "gram")
    # pos identifies the mention by word offset and length; no extra shuffle
    return hits.select("doc_id", "type", (F.col("start") * max_n + F.col("n") - 1).cast("int").alias("pos"),
                       F.col("gram").alias("token"))
