"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Multinomials over hashed n-grams are counted: over a trusted target (documents
labelled good) and over the whole raw corpus.  A document's score is the mean
log ratio of its n-grams, taken for each family of n-grams and summed; every
document at or above one fixed threshold stays.  The families are whole words,
pairs of adjacent words, all character trigrams of the words (case and marks
kept, a space at both ends) and whether a word repeats the one before it, which
stands in for repeated pairs too rare to be counted.  Only DataFrame functions
run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.common import SPACE_CHARS, kept, text_or_empty

#: Hash buckets of each family of n-grams, side by side in one ratio table of so many numbers in all (4.75 MB).
FAMILIES = ("word", "pair", "trigram", "repeat")
BUCKETS = (1 << 18, 1 << 18, 1 << 16, 2)
#: Counts added to each bucket, by family: so many times its mean raw count, at least LEAST; the target gets its share of them.
SMOOTHING = (5.0, 5.0, 0.05, 0.02)
LEAST = (50, 50, 5, 50)
#: Trusted documents whose n-grams make the target counts: at most so many, by hash of their id.
TRUSTED_LIMIT = 20_000
#: Score below which a document goes (0 = as likely under either).
THRESHOLD = -0.25
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Names of the two halves of a text's key.
KEY = ("__key0", "__key1")
#: More partitions than any table has.
MANY = 1 << 24
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def words_of(text: Column) -> Column:
    # a split at one plain character needs no pattern
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _bucket(family: str, *parts: Column) -> Column:
    """Place in the ratio table of the n-gram that ``parts`` make."""
    k = FAMILIES.index(family)
    return (F.pmod(F.xxhash64(*parts), F.lit(BUCKETS[k])) + sum(BUCKETS[:k])).cast("int")


def word_rows(docs: DataFrame, text: Column, *carry: Column) -> DataFrame:
    """One row for each word: ``carry`` and the places of the word, of its pair with the word before, and of whether both
    are the same; the last two are null for a first word.

    The generators are outer ones, with a null filter behind, as an inner one
    has the words cut twice: once more in a filter that the optimizer derives.
    """
    again = sum(BUCKETS[:FAMILIES.index("repeat")])
    w, before = F.col("z.w"), F.col("z.before")
    d = docs.select(*carry, words_of(text).alias("w"))
    d = d.select(*[c for c in d.columns if c != "w"], F.explode_outer(F.arrays_zip("w", F.concat(F.array(F.lit(None).cast("string")), F.col("w")).alias("before"))).alias("z"))
    # the shifted copy is one longer: its last row has no word
    return d.where(w.isNotNull()).select(*[c for c in d.columns if c != "z"], _bucket("word", w).alias("word"),
                                         F.when(before.isNotNull(), _bucket("pair", before, w)).alias("pair"),
                                         F.when(before.isNotNull(), F.when(w == before, again + 1).otherwise(again)).alias("repeat"))


def trigram_rows(docs: DataFrame, text: Column, *carry: Column) -> DataFrame:
    """One row for each character of each word: ``carry`` and the place of the character with its two neighbours (a space
    at both ends of a word).

    The text is read in four bytes a character, where any place is found at once.  Generated code would make the inputs
    of a generator anew for each of its rows; a coalesce that keeps all partitions ends that code, so each is made once.
    """
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"[\x09-\x0D]", " "), F.lit(" "))
    d = docs.select(*carry, F.encode(spaced, "UTF-32").alias("wide")).coalesce(MANY)
    held = [c for c in d.columns if c != "wide"]
    at = F.sequence(F.lit(1), F.greatest(F.octet_length("wide") - 11, F.lit(1)), F.lit(4))
    d = d.where(F.octet_length("wide") >= 12).select(*held, "wide", F.explode_outer(at).alias("at"))
    middle, gram = F.col("wide").substr(F.col("at") + 4, F.lit(4)), F.col("wide").substr(F.col("at"), F.lit(12))
    return d.where(middle != F.lit(b"\0\0\0 ")).select(*held, _bucket("trigram", gram).alias("trigram"))


def window_hashes(hashes: Column):
    """Hashes of every pair of adjacent words (and one more), and what makes the hashes of all windows of five words of them."""
    pairs = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))
    return pairs, lambda p: F.slice(F.transform(p, lambda h, i: F.xxhash64(h, F.get(p, i + 2), F.get(hashes, i + WINDOW - 1))),
                                    F.lit(1), F.greatest(F.size(hashes) - WINDOW + 1, F.lit(0)))


def base_measures(docs: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    d = (docs.withColumn("__text", text).withColumn("__words", words_of(F.col("__text")))
         .withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w))))
    pairs, windows = window_hashes(F.col("__hashes"))
    d = d.withColumn("__two", pairs)
    # without a pair that comes twice there is no window that does
    d = d.withColumn("__windows", F.when(F.size("__two") > F.size(F.array_distinct("__two")), windows(F.col("__two"))))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    d = d.withColumn("__lines", lines)
    # windows with their place, equal ones side by side; only texts with an equal pair get this far
    pairs = F.when(F.size("__windows") > F.size(F.array_distinct("__windows")),
                   F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("__pairs", pairs)
    at = F.transform(
        F.filter("__pairs", lambda x, k: (F.get(F.col("__pairs"), k - 1)["h"] == x["h"]).eqNullSafe(True)
                 | (F.get(F.col("__pairs"), k + 1)["h"] == x["h"]).eqNullSafe(True)), lambda x: x["i"])
    d = d.withColumn("__at", F.sort_array(at))
    covered = F.aggregate(
        F.transform("__at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__at"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    d = (d.withColumn("n_words", F.size("__words").cast("long"))
         .withColumn("word_chars", F.char_length(F.array_join("__words", "")).cast("long"))
         .withColumn("n_symbols", F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"))
         .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
         .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")))
    return (d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
            .drop("__two", "__windows", "__pairs", "__at", "__lines", "__hashes"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               trusted_limit: int = TRUSTED_LIMIT) -> DataFrame:
    """One row with ``ratios``: log(target share / raw share) of each hash bucket.

    Raw counts cover every n-gram of every document.  ``trusted`` (ids in its
    column doc_id) is a bounded fit sample; without any trusted document found,
    all ratios are 0 and only the base rules decide.  Both shares are smoothed
    in proportion, so a bucket that neither side has counts for nothing and one
    that only raw documents have counts against.
    """
    picked = (trusted.select(F.col("doc_id").cast("long").alias("__t")).where(F.col("__t").isNotNull()).distinct()
              .orderBy(F.xxhash64("__t"), "__t").limit(trusted_limit))          # bounded: broadcast below
    rows = (docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
            .join(F.broadcast(picked), F.col("__id") == F.col("__t"), "left")
            .select(F.col("__t").isNotNull().cast("long").alias("good"), "__text"))
    good, text = F.col("good"), F.col("__text")
    # two rows for each word: the word, and its pair with the sign of a repeat, which is counted from the pairs' sums
    again = sum(BUCKETS[:FAMILIES.index("repeat")])
    of_words = word_rows(rows, text, good).select("good", F.explode(F.array(F.col("word").cast("long"), F.col("pair") + F.shiftleft(F.col("repeat").cast("long"), 32))).alias("g"))
    of_words = of_words.where("g is not null")
    of_trigrams = trigram_rows(rows, text, good).select("good", F.col("trigram").cast("long").alias("g"))
    counts = [x.groupBy("g").agg(F.count("*").alias("raw"), F.sum("good").alias("target")) for x in (of_words, of_trigrams)]
    both = counts[0].unionByName(counts[1]).select((F.col("g") % (1 << 32)).cast("int").alias("g"), F.shiftright("g", 32).cast("int").alias("repeat"), "raw", "target")
    counts = (both.select(F.explode(F.when(F.col("repeat") >= again, F.array("g", "repeat")).otherwise(F.array("g"))).alias("g"), "raw", "target")
              .groupBy("g").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    every = docs.sparkSession.range(sum(BUCKETS)).select(F.col("id").cast("int").alias("g"))
    ends = [sum(BUCKETS[:k + 1]) for k in range(len(BUCKETS))]
    family = sum((F.col("g") >= e).cast("int") for e in ends[:-1])

    def totals(name: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("family") == k, F.col(name)).otherwise(0)) for k in range(len(BUCKETS))])
    both = (every.join(counts, "g", "left").select("g", family.alias("family"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "target")])
            .groupBy().agg(totals("raw").alias("all_raw"), totals("target").alias("all_target"),
                           F.array_sort(F.collect_list(F.struct("g", "family", "raw", "target"))).alias("t")))
    added = F.array(*[F.greatest(F.lit(z / n) * F.get("all_raw", F.lit(k)), F.lit(float(least)))
                      for k, (z, n, least) in enumerate(zip(SMOOTHING, BUCKETS, LEAST, strict=True))])
    both = both.withColumn("added", added)

    def ratio(x: Column) -> Column:
        raw, target, more = (F.get(c, x["family"]) for c in ("all_raw", "all_target", "added"))
        # target: (count + added * target / raw) / target, raw: (count + added) / raw
        return F.when(target == 0, F.lit(0.0)).otherwise(F.log((x["target"] * raw / target + more) / (x["raw"] + more)))
    return both.select(F.transform("t", ratio).alias("ratios"))


def family_ratios(ratios: DataFrame) -> DataFrame:
    """The row of :func:`log_ratios`, written as one row for each family: its number and its part of the ratios."""
    ends = [sum(BUCKETS[:k + 1]) for k in range(len(BUCKETS))]
    parts = F.array(*[F.slice("ratios", end - n + 1, n) for end, n in zip(ends, BUCKETS, strict=True)])
    return kept(ratios.select(F.posexplode(parts).alias("family", "ratios")), "log-ratios")


def scores(docs: DataFrame, ratios: DataFrame, text: Column, *keys: Column) -> DataFrame:
    """(KEY, llr) of every text with a word: its words and trigrams as rows, added up by KEY in each task first.

    ``ratios`` comes from :func:`family_ratios`.  The driver packs the ratios that a stage reads into its tasks, once
    for each place that reads them; so each place reads its family's part alone.
    """
    def ratio(place: str) -> Column:
        k = FAMILIES.index(place)
        return F.get(ratios.where(F.col("family") == k).select("ratios").scalar(), F.col(place) - sum(BUCKETS[:k]))

    # words and key are made once for each text, see trigram_rows
    docs = docs.select(*keys, text.alias("__text")).coalesce(MANY)
    text, key = F.col("__text"), [F.col(c) for c in KEY]
    words = (word_rows(docs, text, *key).groupBy(*KEY)
             .agg(F.sum(ratio("word")).alias("s0"), F.sum(ratio("pair")).alias("s1"), F.sum(ratio("repeat")).alias("s3"),
                  F.count("word").alias("n0"), F.count("pair").alias("n1")))
    trigrams = trigram_rows(docs, text, *key).groupBy(*KEY).agg(F.sum(ratio("trigram")).alias("s2"), F.count("trigram").alias("n2"))
    means = words.join(trigrams, list(KEY), "left")
    zero = F.lit(0.0)
    total = sum((F.coalesce(s, zero) / F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))
                 for s, n in ((F.col("s0"), F.col("n0")), (F.col("s1"), F.col("n1")), (F.col("s2"), F.col("n2")), (F.col("s3"), F.col("n1")))), zero)
    return means.select(*KEY, total.alias("llr"))


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD, trusted_limit: int = TRUSTED_LIMIT) -> DataFrame:
    """``docs`` with the base measures, ``llr`` (sum of the families' mean log ratios, null without words) and ``kept``.

    Null and empty texts have no words and fail the base rules.  Each row is
    judged by its text, so ties, repeated rows and null ids need no rule: rows of
    one id and text share one key, and a mean over copies is the mean of one.
    Columns of ``docs`` that have a result's name are replaced.
    """
    ratios = family_ratios(log_ratios(docs, trusted, id_col, text_col, trusted_limit))
    text = text_or_empty(text_col)
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))
    # 120 bits of it as two numbers
    keys = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(c) for at, c in zip((1, 16), KEY, strict=True)]
    judged = scores(docs, ratios, text, *keys)
    # the measures leave through a generator, so that a filter on the verdict does not pull the whole nested expression,
    # copied many times, below the projections
    measures = RESULTS[:RESULTS.index("base_failed") + 1]
    d = base_measures(docs, text).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS], *keys, F.inline(F.array(F.struct(*measures))))
    d = d.join(judged, list(KEY), "left").withColumn("llr", F.when(F.col("n_words") > 0, F.col("llr")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("llr"), F.lit(0.0)) >= threshold))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS], *RESULTS)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that ``labels`` (doc_id, quality) marks good; rows with nulls are left out."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")

