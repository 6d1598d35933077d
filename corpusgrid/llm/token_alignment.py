"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

Every token ends at a byte offset.  Where the ends of an A and a B token meet,
the text falls into groups; inside a group the tokens overlap and are linked.
Both follow from merging the two ascending lists of ends.  A diagonal of the
merge (so many steps from the start) is crossed at one place, which a binary
search finds without the steps before it, so the merge is divided into pieces
of equal work that know nothing of each other.  A piece emits its overlaps and
its cuts; a group that runs over a border is stitched from the pieces' parts.
The pieces of a batch are walked side by side, one numpy lane each.

A text is merged in stretches that neither tokenizer joins: a space behind
anything but white space starts one.  A task merges each distinct stretch once
(a whole text without spaces is one long stretch, and many pieces) and puts the
documents together from them.

How many documents hold an id pair is counted over the whole corpus: blocks of
documents send each of their pairs once with its number of documents, Spark adds
them up, and each block gets the sums for its pairs back.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.common import gather, id_column, id_text, kept, ready, starts_of
from corpusgrid.llm.word_tokens import vocabulary_path

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Steps of the merge in one piece.
WORK = 64
#: A worker forgets its stretches beyond so many, or so many bytes of them.
KEEP_STRETCHES, KEEP_BYTES = 60_000, 16 << 20
#: Text of a block, and of the stretches that go to the tokenizers as one text.
TEXT_BYTES, RUN_BYTES = 1 << 20, 256
#: The writer holds blocks, and a reader takes them, by row groups of about so many bytes; it looks at its size every few rows.
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "8"}
#: Texts that are taken out of an Arrow batch at a time.
BATCH_TEXTS = 512
#: Stretches that are learned at a time.
LEARN = 10_000
#: Fixed value: how byte-level vocabularies split a text before merging.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LAST = np.iinfo(np.int64).max


# --- the merge ------------------------------------------------------------------------------

def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` lie before each diagonal of the merge of two ascending lists (of equal values ``a``'s come first)."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while True:
        seeking = np.flatnonzero(low < high)
        if not len(seeking):
            return low
        mid = (low[seeking] + high[seeking]) >> 1
        more = a[mid] <= b[diagonals[seeking] - mid - 1]
        low[seeking[more]] = mid[more] + 1
        high[seeking[~more]] = mid[~more]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of tokens with ends ``a`` and ``b`` (ascending, same last end): (token of A, token of B, group) in order."""
    total = len(a) + len(b)
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z
    diagonals = np.arange(0, total, work, dtype=np.int64)
    i = crossings(a, b, diagonals)
    j = diagonals - i
    a_end, b_end = np.append(a, _LAST), np.append(b, _LAST)
    a_start, b_start = np.concatenate([[0], a]), np.concatenate([[0], b])
    pieces = len(diagonals)
    at_a, at_b = np.empty((work, pieces), np.int64), np.empty((work, pieces), np.int64)
    linked, cut = np.zeros((work, pieces), bool), np.zeros((work, pieces), bool)
    for k in range(work):
        ea, eb = a_end[i], b_end[j]
        sa, sb = a_start[i], b_start[j]
        at_a[k], at_b[k] = i, j
        live = np.minimum(ea, eb) < _LAST
        linked[k] = np.maximum(sa, sb) < np.minimum(ea, eb)
        linked[k] &= (i < len(a)) & (j < len(b))
        take_a = live & (ea <= eb)
        take_b = live & ~take_a
        cut[k] = take_b & (eb == sa)                       # the A token of the same end has just been taken
        i = i + take_a
        j = j + take_b
    # a piece counts its own cuts; its first group goes on where the piece before it ended
    inside = np.cumsum(cut, 0) - cut
    before = np.concatenate([[0], np.cumsum(cut.sum(0))[:-1]])
    flat = linked.T.ravel()
    return at_a.T.ravel()[flat], at_b.T.ravel()[flat], (inside + before).T.ravel()[flat]


# --- tokens of distinct stretches -----------------------------------------------------------

def byte_values() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in shown}
    for k, x in enumerate(x for x in range(256) if x not in set(shown)):
        table[chr(256 + k)] = x
    return table


def after_space(before: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Whether the byte ``before`` a place (``ahead`` of which stands another) ends white space, or perhaps does.

    White space beyond ASCII ends in one of the byte pairs below.  So do some other
    characters: they cost a stretch, which is no fault.
    """
    last = (before == 0x85) | (before == 0xA0) | ((before >= 0x80) & (before <= 0x8A)) | (before == 0xA8) | (before == 0xA9) | (before == 0xAF) | (before == 0x9F)
    return (before <= 32) | last & ((ahead == 0xC2) | (ahead == 0x9A) | (ahead == 0x80) | (ahead == 0x81))


def stretch_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the stretches of a buffer start: at every text's start, and at a space that follows no white space."""
    space = np.flatnonzero(data[1:] == 32) + 1
    begins = np.zeros(len(data), bool)
    begins[space[~after_space(data[space - 1], data[np.maximum(space - 2, 0)])]] = True
    begins[starts] = True
    return np.flatnonzero(begins)


def ranked_encoding(rules: dict):
    """A tokenizer file's vocabulary and merges in tiktoken, three times as fast; None if merging by id would be another rule.

    Its character classes might differ from the tokenizer's in characters that
    Unicode added lately, so only Latin texts go to it.
    """
    import tiktoken
    model, before = rules["model"], rules.get("pre_tokenizer") or {}
    plain = (before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not rules.get("normalizer")
             and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    values, merges = byte_values(), [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {x["content"] for x in rules["added_tokens"]}
    ranks = {bytes(values[c] for c in t): k for t, k in model["vocab"].items() if t not in special}
    in_order = [model["vocab"][a + b] for a, b in merges] == list(range(256, 256 + len(merges))) and len(ranks) == 256 + len(merges)
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={}) if in_order else None


class Stretches:
    """The distinct stretches a worker has met: their tokens, links and groups."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        with open(path_a, encoding="utf-8") as f:
            rules = json.load(f)
        self.path_a, self.tokenizer, self.ranked = path_a, None, ranked_encoding(rules)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        values = byte_values()
        vocabulary = rules["model"]["vocab"] | {x["content"]: x["id"] for x in rules["added_tokens"]}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.bytes_a[k] = bytes(values[c] for c in piece) if all(c in values for c in piece) else piece.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        if any(" " in p.decode("utf-8", "ignore").lstrip(" ") for p in self.bytes_b):
            raise ValueError("a piece of the second vocabulary goes on after a space; stretches would cut it")
        self.space = self.b.piece_to_id("▁")
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # an id as text and what follows it: A's ids end in , or |, B's in , or ; or a line end behind a stretch's last
        self.told = [b"%d%b" % (k, sign) for table, signs in ((self.bytes_a, b",|"), (self.bytes_b, b",;\n"))
                     for sign in (signs[i:i + 1] for i in range(len(signs))) for k in range(len(table))]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.held = 0
        self.groups: list[bytes] = []                      # groups as text
        self.whole = np.zeros(0, bool)                     # both tokenizers give the bytes back
        self.count = np.zeros((0, 3), np.int64)            # A tokens, B tokens, groups
        self.first = np.zeros(0, np.int64)                 # first link in pairs
        self.links = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)                 # A id << 32 | B id

    @property
    def a(self):
        """The first tokenizer, read when a text first needs it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_file(self.path_a)
            self.tokenizer.encode_special_tokens = True    # their strings inside texts are plain text
        return self.tokenizer

    def _encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        latin = [self.ranked is not None and (t.isascii() or max(t) < "\u0250") for t in texts]
        other = [t for t, x in zip(texts, latin, strict=True) if not x]
        other = iter(self.a.encode_batch_fast(other, add_special_tokens=False) if other else ())
        ids_a = [self.ranked.encode_ordinary(t) if x else next(other).ids for t, x in zip(texts, latin, strict=True)]
        # B puts the leading space itself, but not before an empty text
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return ids_a, [x if t != " " else [self.space] for x, t in zip(ids_b, texts, strict=True)]

    def _side_by_side(self, new: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """(A ids, A tokens of each, B ids, B tokens of each) of stretches that end in no white space, joined to longer texts;
        None if the joined texts do not come back byte for byte."""
        sizes = np.array([len(x) for x in new], np.int64)
        edges = np.cumsum(sizes)
        cuts = np.searchsorted(edges, np.arange(RUN_BYTES, edges[-1] + RUN_BYTES, RUN_BYTES)) + 1
        runs = [b"".join(new[x:y]) for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
        ids_a, ids_b = self._encoded([x.decode("utf-8", "replace") for x in runs if x])
        out, joined = [], b"".join(runs)
        for ids, size, table in ((ids_a, self.size_a, self.bytes_a), (ids_b, self.size_b, self.bytes_b)):
            flat = [k for x in ids for k in x]
            if b"".join(map(table.__getitem__, flat)) != joined:
                return None
            flat = np.array(flat, np.int64)
            end = np.cumsum(size[flat])
            last = np.searchsorted(end, edges)
            if (end[last] != edges).any():
                return None
            out += [flat, np.diff(last, prepend=-1)]
        return tuple(out)

    def _one_by_one(self, new: list[bytes]) -> tuple[np.ndarray, ...]:
        """The same for any stretches; those that do not come back byte for byte get no tokens."""
        out = []
        found = self._encoded([x.decode("utf-8", "replace") for x in new])
        whole = [b"".join([self.bytes_a[k] for k in x]) == raw == b"".join([self.bytes_b[k] for k in y]) for raw, x, y in zip(new, *found, strict=True)]
        for ids in found:
            ids = [x if w else [] for x, w in zip(ids, whole, strict=True)]
            out += [np.array([k for x in ids for k in x], np.int64), np.array([len(x) for x in ids], np.int64)]
        return tuple(out)

    def learn(self, new: list[bytes]) -> None:
        tail = np.array([x[-2:].rjust(2, b" ") for x in new], "S2").view(np.uint8).reshape(-1, 2) if new else np.zeros((0, 2), np.uint8)
        lone = after_space(tail[:, 1], tail[:, 0]).tolist()
        lone = [odd or "▁".encode() in x for odd, x in zip(lone, new, strict=True)]
        joint, apart = [x for x, odd in zip(new, lone, strict=True) if not odd], [x for x, odd in zip(new, lone, strict=True) if odd]
        parts = [self._side_by_side(joint) or self._one_by_one(joint)] if joint else []
        ids_a, n_a, ids_b, n_b = (np.concatenate(x) for x in zip(*parts, *([self._one_by_one(apart)] if apart else []), strict=True))
        new = joint + apart
        at_a, at_b, group = overlaps(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))
        first_a = np.concatenate([[0], np.cumsum(n_a)])
        link_at = np.searchsorted(at_a, first_a)
        group_of_a, group_of_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        group_of_a[at_a], group_of_b[at_b] = group, group
        group_at = np.append(group_of_a, group[-1] + 1 if len(group) else 0)[first_a]
        # all tokens by group, A's before B's, each with the sign that follows it
        key = np.concatenate([2 * group_of_a, 2 * group_of_b + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        ends = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
        is_b = key & 1 == 1
        owner = np.concatenate([np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)])[order]
        closes = np.append(owner[1:] != owner[:-1], True) if len(owner) else ends
        code = np.concatenate([ids_a, ids_b])[order] + np.where(
            is_b, 2 * len(self.bytes_a) + (ends + (ends & closes).astype(np.int64)) * len(self.bytes_b), ends * len(self.bytes_a))
        told = iter(b"".join(map(self.told.__getitem__, code.tolist())).split(b"\n"))
        first = len(self.groups)
        self.slot.update(zip(new, range(first, first + len(new)), strict=True))
        self.held += sum(map(len, new))
        some = n_a > 0
        self.groups += [next(told) if x else b"" for x in some.tolist()]
        self.whole = np.concatenate([self.whole, some])
        self.count = np.concatenate([self.count, np.stack([n_a, n_b, np.diff(group_at)], 1)])
        self.first = np.concatenate([self.first, len(self.pairs) + link_at[:-1]])
        self.links = np.concatenate([self.links, np.diff(link_at)])
        self.pairs = np.concatenate([self.pairs, ids_a[at_a] << 32 | ids_b[at_b]])

    def slots(self, distinct: list[bytes]) -> np.ndarray:
        if len(self.slot) > KEEP_STRETCHES or self.held > KEEP_BYTES:
            self.forget()
        new = [x for x in distinct if x not in self.slot]
        for k in range(0, len(new), LEARN):
            self.learn(new[k:k + LEARN])
        return np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))


_KNOWN: dict[tuple[str, str], Stretches] = {}


def stretches(path_a: str, path_b: str) -> Stretches:
    if (path_a, path_b) not in _KNOWN:
        _KNOWN[path_a, path_b] = Stretches(path_a, path_b)
    return _KNOWN[path_a, path_b]


def trimmed() -> None:
    """Give freed memory back to the system: a worker keeps the most that any block took otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                      # another C library than glibc
        pass


def forget_all() -> None:
    """Drop tokenizers and stretches: the worker goes on with a step that needs neither."""
    if _KNOWN:
        _KNOWN.clear()
        trimmed()


def expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then the same for the next."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - count), count)


# --- blocks of documents --------------------------------------------------------------------

#: stats: A tokens, B tokens, groups, links of each document; of, times: its distinct stretches; pair_of: links of the stretches.
BLOCKS = "block long, ids binary, stats binary, digests binary, documents_at binary, of binary, times binary, stretches_at binary, pair_of binary, pairs array<long>, documents array<long>"


def aligned_block(known: Stretches, ids: np.ndarray, ends: np.ndarray, body: bytes) -> dict:
    # the byte before each text (the separator, or one put in front) becomes the space that both tokenizers start with
    data = np.frombuffer(b" " + body, np.uint8).copy()
    starts = starts_of(ends)
    data[starts] = 32
    cuts = stretch_starts(data, starts)
    offsets = np.append(cuts, len(data)).astype(np.int32)
    column = pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    slot = known.slots(column.dictionary.to_pylist())
    of = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.append(np.searchsorted(cuts, starts), len(cuts))
    # documents that a tokenizer does not give back, and empty ones, have no tokens
    broken = np.add.reduceat((~known.whole[slot])[of], first[:-1]) > 0 if len(ids) else np.zeros(0, bool)
    broken |= ends + 1 - starts == 1
    document = np.repeat(np.arange(len(ids)), np.diff(first))
    digests = []
    told = [known.groups[k] for k in slot.tolist()]
    order, edges = of.tolist(), first.tolist()
    for d, bad in enumerate(broken.tolist()):
        digests.append(bytes(32) if bad else hashlib.sha256(b";".join(map(told.__getitem__, order[edges[d]:edges[d + 1]]))).digest())
    good = ~broken[document]
    key, times = np.unique(document[good] * len(slot) + of[good], return_counts=True)
    document, of = key // max(1, len(slot)), key % max(1, len(slot))
    per = np.concatenate([known.count[slot], known.links[slot][:, None]], 1)
    stats = np.zeros((len(ids), 4), np.int64)
    for c in range(4):
        stats[:, c] = np.bincount(document, weights=per[of, c] * times, minlength=len(ids))
    # only stretches of documents with tokens have links here
    used = np.zeros(len(slot), bool)
    used[of] = True
    n_links = np.where(used, known.links[slot], 0)
    pairs, pair_of = np.unique(known.pairs[expanded(known.first[slot], n_links)], return_inverse=True)
    stretches_at = np.concatenate([[0], np.cumsum(n_links)])
    held = np.unique(np.repeat(document, n_links[of]) * max(1, len(pairs)) + pair_of[expanded(stretches_at[of], n_links[of])])
    return {"ids": ids.tobytes(), "stats": stats.tobytes(), "digests": b"".join(digests),
            "documents_at": np.searchsorted(document, np.arange(len(ids) + 1)).tobytes(), "of": of.astype(np.int32).tobytes(),
            "times": times.astype(np.int32).tobytes(), "stretches_at": stretches_at.tobytes(), "pair_of": pair_of.astype(np.int32).tobytes(),
            "pairs": pairs, "documents": np.bincount(held % max(1, len(pairs)), minlength=len(pairs))}


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        known, task = stretches(path_a, path_b), TaskContext.get().partitionId()
        few = (batch.slice(at, BATCH_TEXTS) for batch in batches for at in range(0, batch.num_rows, BATCH_TEXTS))
        for made, (ids, ends, body) in enumerate(gather(few, TEXT_BYTES)):
            row = {"block": task << 32 | made} | aligned_block(known, ids, ends, body)
            trimmed()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.list_(pa.int64()) if k in ("pairs", "documents") else pa.int64() if k == "block" else pa.binary())
                 for k, x in row.items()], names=list(row))

    ready(docs.sparkSession)
    return kept(id_text(docs, id_col, text_col).mapInArrow(run, BLOCKS), "aligned", ROW_GROUPS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each id pair, and whether no pair of the same A id has more."""
    sent = blocks.select(F.explode_outer(F.arrays_zip("pairs", "documents")).alias("p")).where("p.pairs is not null")
    counts = kept(sent.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.documents").alias("n")), "pair-counts")
    # at most one row for each id of A's vocabulary
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return (counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a"))
            .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _documents(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    forget_all()
    parts = []
    n, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    at = answers.column("pos").to_numpy()
    n[at], best[at] = answers.column("n").to_numpy(), answers.column("best").cast(pa.int64()).to_numpy()
    for row in blocks.to_pylist():
        ids, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["documents_at"], np.int64)
        of, times = np.frombuffer(row["of"], np.int32), np.frombuffer(row["times"], np.int32).astype(np.int64)
        pair_of, edge = np.frombuffer(row["pair_of"], np.int32), np.frombuffer(row["stretches_at"], np.int64)
        stats = np.frombuffer(row["stats"], np.int64).reshape(-1, 4)

        def summed(value: np.ndarray) -> np.ndarray:
            of_links = np.concatenate([[0], np.cumsum(value[pair_of])])
            of_stretches = np.concatenate([[0], np.cumsum((of_links[edge[1:]] - of_links[edge[:-1]])[of] * times)])
            return of_stretches[at[1:]] - of_stretches[at[:-1]]

        told = [row["digests"][32 * k:32 * k + 32].hex() if x else "" for k, x in enumerate(stats[:, 0].tolist())]
        parts.append(pa.table([id_column(ids), *[pa.array(stats[:, c]) for c in range(4)], pa.array(summed(best)), pa.array(summed(n)), pa.array(told, pa.string())],
                              names=[x.split()[0] for x in OUT.split(", ")]))
    return pa.concat_tables(parts) if parts else pa.schema([(x.split()[0], pa.string() if "sha" in x else pa.int64()) for x in OUT.split(", ")]).empty_table()


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A's tokens are those of a space and the text, B puts that space itself.
    Null and empty texts, and texts that a tokenizer does not give back byte for
    byte, have no tokens: zeros and an empty digest.  ``n_best`` counts the links
    whose id pair is held by as many documents as any pair of its A id (ties
    included); ``count_sum`` adds up the pairs' documents over the links.  Rows
    that repeat an id, and null ids, are documents of their own.  An empty table
    gives none.  Other columns of ``docs`` are not read.
    """
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)
    blocks = aligned_blocks(docs, path_a, path_b, id_col, text_col)
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("pos", "pair"))
    answers = asked.join(pair_counts(blocks), "pair").select("asker", "pos", "n", "best")
    return (blocks.select("block", "ids", "stats", "digests", "documents_at", "of", "times", "stretches_at", "pair_of").groupBy("block")
            .cogroup(answers.groupBy("asker")).applyInArrow(_documents, OUT))
