"""W18 vocabulary and W12 sequence encoding (token ids + one-hot labels).

Encoding: ``[CLS] + word pieces + [SEP]`` -> ids, zero-padded or cut to
``max_seq_length`` (a cut drops the closing ``[SEP]``, as the reference does;
``keep_sep=True`` keeps it).  Words come from built-in Spark expressions
(lower-case, accent folding, split on white space and punctuation) over the
whole text; each word is split into pieces by greedy longest-match-first
against the vocabulary (the published word-piece algorithm), ``[UNK]`` when no
split exists or the word is too long.

Plan: the vocabulary has a proven size bound (``size`` words plus the distinct
characters), is collected once and shipped to executors as a broadcast
variable; encoding is then a narrow, per-partition Arrow UDF over the texts --
no shuffle, no per-token rows -- with a dictionary so each distinct word is
split once per task (P7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrid.functions.arrays import one_hot, pad_truncate
from corpusgrid.functions.text import MAX_CHARS_PER_WORD, chunks, unicode_words, words
from corpusgrid.session import materialize

# --- fixed values: special pieces and their ids in a built vocabulary --------
SPECIALS = (("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3), ("[MASK]", 4))
CONTINUATION = "##"
# -----------------------------------------------------------------------------

MAX_VOCAB_ROWS = 5_000_000
MAX_LITERAL_CLASSES = 256   # a literal map lookup scans its keys; above this a join is used


def word_counts(docs: DataFrame, text_col: str = "text", rule: str = "ascii") -> DataFrame:
    """(word, count) over all texts; partial aggregation collapses hot words map side.

    With the Unicode rule the distinct chunks are counted first; Python splits
    each of them once, whatever the number of texts."""
    # explode_outer + null filter: an inner explode would make the optimizer
    # push a second copy of the word split below the preceding exchange
    cut = {"ascii": words, "unicode": chunks}[rule]
    counts = (docs.select(F.explode_outer(cut(F.col(text_col))).alias("word")).where(F.col("word").isNotNull())
              .groupBy("word").agg(F.count(F.lit(1)).alias("count")))
    if rule == "ascii":
        return counts

    def split(batches):
        import pyarrow as pa
        for rb in batches:
            found = [unicode_words(w) for w in rb.column("word").to_pylist()]
            sizes = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([w for x in found for w in x], pa.string()),
                                              pa.array([c for c, k in zip(rb.column("count").to_pylist(), sizes, strict=True) for _ in range(k)], pa.int64())],
                                             names=["word", "count"])
    return counts.mapInArrow(split, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def build_vocabulary(docs: DataFrame, text_col: str = "text", size: int = 30000, rule: str = "ascii") -> DataFrame:
    """(piece, id).

    Pieces = the ``size`` most frequent words (ties by word) + every character
    seen + its continuation form; special pieces take ids 0-4, the rest are
    numbered in piece order.  With every character present, each word has a
    split, so ``[UNK]`` only marks over-long words.
    """
    # the word table feeds two branches (top words, characters): written once
    counts = materialize(word_counts(docs, text_col, rule), "word_counts")
    top = counts.orderBy(F.col("count").desc(), F.col("word")).limit(size).select(F.col("word").alias("piece"))
    chars = counts.select(F.explode(F.split("word", "")).alias("c")).where(F.col("c") != "").distinct()
    char_pieces = chars.select(F.explode(F.array("c", F.concat(F.lit(CONTINUATION), "c"))).alias("piece"))
    special_names = [p for p, _ in SPECIALS]
    pieces = top.unionByName(char_pieces).distinct().where(~F.col("piece").isin(special_names))
    spark = docs.sparkSession
    specials = spark.createDataFrame(list(SPECIALS), "piece string, id int")
    # vocabulary rows are bounded by size + 2 * (distinct characters)
    numbered = pieces.select("piece", (F.row_number().over(Window.orderBy("piece")) + len(SPECIALS) - 1)
                             .cast("int").alias("id"))
    return specials.unionByName(numbered)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Read a ``vocab.txt`` (one piece per line, id = line number)."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("id", "piece"))
    return lines.select("piece", F.col("id").cast("int").alias("id"))


def piece_limits(vocab: dict) -> tuple[int, int]:
    """Longest word-initial piece and longest continuation piece (without '##')."""
    first = max((len(p) for p in vocab if not p.startswith(CONTINUATION)), default=0)
    cont = max((len(p) - len(CONTINUATION) for p in vocab if p.startswith(CONTINUATION)), default=0)
    return first, cont


def _wordpiece(word: str, vocab: dict, unk: int, limits: tuple[int, int] | None = None) -> list[int]:
    """Greedy longest-match-first split; candidates longer than the longest
    vocabulary piece are skipped (they cannot match), which keeps the split
    linear in the word length for character-level continuation pieces."""
    if len(word) > MAX_CHARS_PER_WORD:
        return [unk]
    first, cont = limits if limits is not None else (len(word), len(word))
    out, start, n = [], 0, len(word)
    while start < n:
        end, found = min(n, start + (first if start == 0 else cont)), None
        while start < end:
            sub = word[start:end] if start == 0 else CONTINUATION + word[start:end]
            found = vocab.get(sub)
            if found is not None:
                break
            end -= 1
        if found is None:
            return [unk]
        out.append(found)
        start = end
    return out


MEMO_LIMIT = 200_000
CHUNK_TEXTS = 256           # texts whose words and pieces a task holds at once


def _expanded(first, count):
    """first[0], first[0] + 1, ... (count[0] of them), then the same for the next."""
    import numpy as np
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - count), count)


def _encoder(bvocab, unk: int, cls: int, sep: int, max_len: int, keep_sep: bool, rule: str):
    """Arrow batches of (doc_id, words or chunks joined by one space) -> (doc_id, n_pieces, ids).

    ``ids`` is already cut to ``max_len`` (a cut drops the closing marker unless
    ``keep_sep``); ``n_pieces`` counts every piece of the whole text.

    Neither words nor chunks contain a space, so joining by a space and
    splitting again is exact.  A batch's words are dictionary-encoded by Arrow;
    each distinct one is split into pieces once per task (bounded memo), and the
    texts are put together from the dictionary with numpy.
    """
    def encode(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        table = bvocab.value
        limits = piece_limits(table)
        split = unicode_words if rule == "unicode" else lambda w: [w]
        slot: dict[str, int] = {}
        flat = np.zeros(0, np.int32)
        first = count = np.zeros(0, np.int64)
        # taken, not sliced: Arrow's string functions misread a slice's offsets
        chunks_of = (b.take(pa.array(np.arange(at, min(at + CHUNK_TEXTS, b.num_rows)))) for b in batches for at in range(0, b.num_rows, CHUNK_TEXTS))
        for rb in chunks_of:
            n = rb.num_rows
            texts = rb.column("_w")
            lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, texts), pattern=" ")
            per_row = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(slot) > MEMO_LIMIT:
                slot, flat = {}, np.zeros(0, np.int32)
                first = count = np.zeros(0, np.int64)
            new = [w for w in distinct if w not in slot]
            if new:
                found = [[x for word in split(w) for x in _wordpiece(word, table, unk, limits)] for w in new]
                slot.update(zip(new, range(len(count), len(count) + len(new)), strict=True))
                sizes = np.array([len(x) for x in found], np.int64)
                first = np.concatenate([first, len(flat) + np.cumsum(sizes) - sizes])
                count = np.concatenate([count, sizes])
                flat = np.concatenate([flat, np.array([i for x in found for i in x], np.int32)])
            at = np.array([slot[w] for w in distinct], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.int64)
            # pieces of a row = pieces of its words
            ends = np.concatenate([[0], np.cumsum(count[at])])
            edge = ends[np.concatenate([[0], np.cumsum(per_row)])]
            pieces = flat[_expanded(first[at], count[at])]
            n_pieces = np.diff(edge)
            # [CLS] + pieces + [SEP], cut to max_len in the task: only max_len ids per text go back to the JVM
            kept = np.minimum(n_pieces + 2, max_len)
            inside = np.minimum(n_pieces, max(max_len - 1, 0))
            off = np.concatenate([[0], np.cumsum(kept)])
            out = np.full(off[-1], cls, np.int32)
            out[_expanded(off[:-1] + 1, inside)] = pieces[_expanded(edge[:-1], inside)]
            closed = (n_pieces + 2 <= max_len) | keep_sep
            out[(off[1:] - 1)[closed & (kept > 0)]] = sep
            ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(n_pieces.astype(np.int32)), ids],
                                             names=["doc_id", "n_pieces", "_ids"])
    return encode


def encode_sequences(docs: DataFrame, vocab: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     max_seq_length: int = 128, keep_sep: bool = False, rule: str = "ascii") -> DataFrame:
    """(doc_id, n_pieces, input_ids array<int>[max_seq_length]).

    ``n_pieces`` counts all pieces of the whole text (before the cut).  ``rule``
    is the word rule that the vocabulary was built with (``functions.text``).
    """
    cut = {"ascii": words, "unicode": chunks}[rule]
    spark = docs.sparkSession
    rows = vocab.select("piece", "id").limit(MAX_VOCAB_ROWS + 1).collect()
    if len(rows) > MAX_VOCAB_ROWS:
        raise ValueError(f"vocabulary larger than {MAX_VOCAB_ROWS} pieces; not broadcast")
    table = {r["piece"]: int(r["id"]) for r in rows}
    unk, cls, sep = table["[UNK]"], table["[CLS]"], table["[SEP]"]
    bvocab = spark.sparkContext.broadcast(table)
    id_type = dict(docs.dtypes)[id_col]
    joined = docs.select(F.col(id_col).alias("doc_id"), F.array_join(cut(F.col(text_col)), " ").alias("_w"))
    full = joined.mapInArrow(_encoder(bvocab, unk, cls, sep, max_seq_length, keep_sep, rule),
                             f"doc_id {id_type}, n_pieces int, _ids array<int>")
    return full.select("doc_id", "n_pieces", pad_truncate(F.col("_ids"), max_seq_length).alias("input_ids"))


def label_codes(df: DataFrame, label_col: str = "label", code_col: str = "label_code",
                handle_null: str = "drop") -> tuple[DataFrame, int]:
    """code = position of the label in sorted distinct labels.

    Returns (df with ``code_col``, num_classes).  Null labels are dropped, or
    with ``handle_null='keep'`` get the extra last code (never a silent wrap).
    Up to ``MAX_LITERAL_CLASSES`` classes the sorted label list is collected
    and applied as a literal map (no join); beyond that the codes come from
    ``global_rank`` over the distinct labels and a join.
    """
    if handle_null not in ("drop", "keep"):
        raise ValueError("handle_null must be 'drop' or 'keep'")
    distinct = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    labels = [r[0] for r in distinct.orderBy(label_col).limit(MAX_LITERAL_CLASSES + 1).collect()]
    if len(labels) <= MAX_LITERAL_CLASSES:
        num = len(labels)
        if labels:
            mapping = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
            code = F.element_at(mapping, F.col(label_col))
        else:
            code = F.lit(None).cast("int")
        coded = df.withColumn(code_col, code)
    else:
        from corpusgrid.operators.ranking import global_rank
        dim, num = global_rank(distinct, [label_col], rank_col=code_col, label="label_dim")
        coded = df.join(dim.withColumn(code_col, F.col(code_col).cast("int")), label_col, "left")
    if handle_null == "keep":
        return coded.withColumn(code_col, F.coalesce(F.col(code_col), F.lit(num))), num + 1
    return coded.where(F.col(label_col).isNotNull()), num


def one_hot_labels(df: DataFrame, code_col: str, num_classes: int, out_col: str = "label_onehot") -> DataFrame:
    return df.withColumn(out_col, one_hot(F.col(code_col), num_classes))

