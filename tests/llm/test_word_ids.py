"""Words of letters are encoded many at a time: the same ids as one text at a time, in fewer calls."""

from __future__ import annotations

import hashlib

import numpy as np

from corpusgrid.llm.token_codec import read_frame, write_frame
from corpusgrid.llm.word_tokens import JOINED, WordIds, vocabulary_path

ODD = ["", "  ", "İstanbul İ ǅ ﬁn ﬀ  áb é é Å 漢字 漢字かな ᄀ가 ½ ² ª º ʰx", "a<|startoftext|>b don't it's O'Neill 'S x'll",
       "a\tb\x0bc d e​f", "� x�", "ß ẞ ſ ŉ ΐ ΣΑΣ Σ ς", "ไทย हिन्दी العربية", "a1b2 12.5 A-B u.s.a. ... !!! a!!!!!!!!!!!!", "𝒜𝒷 𐐀𐐨 🙂 a🙂b"]


def _encode(encoder, texts):
    raw = [t.encode() for t in texts]
    return encoder.encode(np.cumsum([len(x) + 1 for x in raw], dtype=np.int64) - 1, b"\n".join(raw), 2)


def test_ids_equal_those_of_whole_texts():
    encoder = WordIds(vocabulary_path())
    for texts in (ODD, ODD, [""], ["word"], ODD[::-1]):
        ids, at = _encode(encoder, texts)
        expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == expected and at[-1] == len(ids)
    ids, at = encoder.encode(np.zeros(0, np.int64), b"", 2)
    assert len(ids) == 0 and at.tolist() == [0]


def test_words_of_letters_go_to_the_encoder_together():
    encoder, calls = WordIds(vocabulary_path()), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    words = [f"{a}{b}{c}" for a in "qwertzuiop" for b in "asdfghjkl" for c in ("xé", "vy", "nm")]
    expected = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    encoder.tokenizer = Counted(encoder.tokenizer)
    ids, _ = _encode(encoder, [" ".join(words)])
    assert ids.tolist() == [i for x in expected for i in x] + [2]
    assert len(calls) == -(-len(words) // JOINED) < len(words)


def test_a_word_is_looked_up_once_unless_it_is_new():
    encoder, asked = WordIds(vocabulary_path()), []

    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    encoder.slot = Counted()
    words = [f"word{a}x" for a in "abcdefghij"]
    expected = [i for w in words for i in encoder.tokenizer.encode(w, add_special_tokens=False).ids]
    assert _encode(encoder, [" ".join(words)])[0].tolist() == expected + [2]
    asked.clear()
    assert _encode(encoder, [" ".join([*words, "other"])])[0].tolist()[:len(expected)] == expected
    assert len(asked) == len(words) + 2


def test_frames_keep_their_bytes():
    k = np.arange(50_000, dtype=np.uint64)
    ids = ((k * k * np.uint64(2654435761) >> np.uint64(20)) % (k % np.uint64(97) + np.uint64(2))).astype(np.uint32)
    frame = write_frame(np.array([3, 4]), np.array([30_000, 20_000]), ids)
    assert hashlib.sha256(frame).hexdigest() == "c6a4be2eab382a3061e7a4e3b70470eba75562e2efd996ee6dded0e6d3f32c36"
    assert (read_frame(frame)[2] == ids).all()
