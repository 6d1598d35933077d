"""Token ids of whole texts with a public vocabulary, each distinct word encoded once.

``word_bpe_49k`` cuts at white space before anything else: no normalisation,
match or merge reaches over it.  A text's ids are therefore its words' ids in
order, and a task encodes each distinct word once and gathers the rest.

Fewer words are distinct after two steps that its rules allow.  Punctuation that
ends a word behind an ASCII letter or digit is a piece of its own there, so it is
looked up apart from the word.  It lower-cases, so words of ASCII characters share
an entry in any case; with others a capital can matter, as composition comes first.
Vocabularies with other rules are used without these steps.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

from corpusgrid.llm.common import SPACE_BYTES, starts_of, word_bounds, word_segments

#: A worker forgets its words beyond this many (about 180 MB), whatever the input's size.
KEEP_WORDS = 900_000
VOCABULARY = "word_bpe_49k.json"
#: Fixed value: the split pattern of word_bpe_49k, in which a run of ASCII punctuation never joins the letter or digit before it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ending punctuation of more characters stays with its word.
TAIL = 8
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_ALNUM = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57))
_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_ALNUM
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: So many words of letters go to the encoder as one text.
JOINED = 256
#: Ends the last piece of each part that the split pattern finds.
SUFFIX = "</w>"
_KNOWN: dict[str, WordIds] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def cut_tails(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with up to ``TAIL`` ending punctuation bytes behind an ASCII letter or digit become two pieces."""
    body = end.copy()
    at = np.flatnonzero(_PUNCT[data[end - 1]])
    for _ in range(TAIL):
        body[at] -= 1
        at = at[body[at] > start[at]]
        at = at[_PUNCT[data[body[at] - 1]]]
    cut = np.flatnonzero(body < end)
    cut = cut[body[cut] > start[cut]]
    cut = cut[_ALNUM[data[body[cut] - 1]]]
    return (np.insert(start, cut + 1, body[cut]), np.insert(end, cut, body[cut]))


def fold_case(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased in words that are ASCII throughout."""
    folded = _LOWER[data]
    if not len(start):
        return folded
    # a capital in a word with wider characters stays; white space between words is neither
    wide = np.flatnonzero(np.logical_or.reduceat(data > 127, start) & np.logical_or.reduceat(folded != data, start))
    if len(wide):
        size = (end - start)[wide]
        at = np.arange(size.sum()) + np.repeat(start[wide] - (np.cumsum(size) - size), size)
        folded[at] = data[at]
    return folded


class WordIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        known = first.get("pattern") == {"Regex": SPLIT}
        steps = (rules.get("normalizer") or {}).get("normalizers") or []
        self.cuts, self.folds = known, known and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        model = rules.get("model") or {}
        # whether an id ends a part; none where the vocabulary's rules are others
        self.ends = None
        if self.folds and model.get("type") == "BPE" and model.get("end_of_word_suffix") == SUFFIX:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.ends[[i for w, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if w.endswith(SUFFIX)]] = True
        self.forget()

    def pieces(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, pa.DictionaryArray]]:
        """For each segment of the bytes: where its pieces start, and the pieces (folded) as a dictionary-encoded column.

        Arrow compares the bytes themselves, so different words never share an entry."""
        for at, piece in word_segments(data):
            start, end = word_bounds(piece)
            if self.cuts and len(start):
                start, end = cut_tails(piece, start, end)
            folded = fold_case(piece, start, end) if self.folds else piece
            # the pieces hold every byte but white space, in order
            packed = folded[~SPACE_BYTES[piece]]
            offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
            yield start + at, pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, how many each has)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count

    def _add(self, words: list[bytes], flat: np.ndarray, count: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.count), len(self.count) + len(words)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters alone, each one part of the split pattern, are encoded many at a time and told apart by the
        pieces that end a part; where their number is another, and for all other words, one at a time."""
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.ends is not None:
            plain = [t.isalpha() and t.lower().isalpha() for t in texts]
            some, whole = list(compress(words, plain)), list(compress(texts, plain))
            flat, _ = self._encoded([" ".join(whole[k:k + JOINED]) for k in range(0, len(whole), JOINED)])
            at = np.flatnonzero(self.ends[flat]) + 1
            if len(at) == len(some) and (not len(flat) or at[-1:] == len(flat)):
                self._add(some, flat, np.diff(at, prepend=0))
                other = [not x for x in plain]
                words, texts = list(compress(words, other)), list(compress(texts, other))
        self._add(words, *self._encoded(texts))

    def _slots(self, distinct: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.slot.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [distinct[k] for k in missing.tolist()]
            self._learn(new)
            found[missing] = [self.slot[w] for w in new]
        return found

    def encode(self, ends: np.ndarray, body: bytes, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text followed by ``last``; offsets of the texts, one more than texts)."""
        if len(self.slot) > KEEP_WORDS:
            self.forget()
        starts, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, column in self.pieces(np.frombuffer(body, np.uint8)):
            starts.append(start)
            slots.append(self._slots(column.dictionary.to_numpy(zero_copy_only=False).tolist())[column.indices.to_numpy(zero_copy_only=False)])
        start, slot = np.concatenate(starts), np.concatenate(slots)
        # a text's end is one more piece, the last id of the table
        behind = np.concatenate([np.searchsorted(start, starts_of(ends))[1:], [len(start)]]) if len(ends) else np.zeros(0, np.int64)
        first, count = np.insert(self.first[slot], behind, len(self.flat)), np.insert(self.count[slot], behind, 1)
        total = np.cumsum(count)
        at = np.repeat(first - (total - count), count)
        at += np.arange(len(at))
        out = np.append(self.flat, np.uint32(last)).take(at)
        return out, np.concatenate([[0], total[behind + np.arange(len(behind))]])


def word_ids(path: str) -> WordIds:
    """This worker process's encoder for ``path``; it lives as long as the worker."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]
