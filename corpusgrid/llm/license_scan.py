"""License scans: template markup compiled into token automata, beside a base search for phrases.

A template is a license text or notice with marked regions.  Words outside them
are mandatory and match exactly, case of A-Z and punctuation aside; an optional
region may be left out; a replaceable one takes some number of any words.  A
template becomes an automaton over words, whose subset states are made when a
text first reaches them.  A text has a template's label where the automaton,
started at some word, accepts; the longest accepted run of words is the span.

Words are cut and looked up for megabytes of documents at once, and an automaton
is started only where its first two words allow it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusgrid.llm.common import gather, id_column, id_text, ready, starts_of

# --- fixed values: base phrases and their labels ---------------------------------------------
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# --- fixed values: the licenses' own wording, with marked regions ----------------------------
MIT = """<<beginOptional>>The MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> <<beginOptional>>Copyright (c) <<var;name="holder";words="1-20">><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="liable";words="1-20">> BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
<<var;name="holder";words="1-20">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL <<var;name="liable";words="1-20">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. """
BSD_NAMES = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";words="1-20">> nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. """
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;name="provider";words="1-20">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
APACHE = """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0<<endOptional>>"""
GPL_LINE = """<<beginOptional>>This <<var;name="work";words="1-3">> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
<<beginOptional>>as published by the Free Software Foundation<<endOptional>> version %s <<beginOptional>>of the License<<endOptional>>
<<beginOptional>>or (at your option) any later version<<endOptional>>"""
GPL_HEAD = """free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version %s of the License, or (at your option) any later version."""
MIT_LINE = """<<beginOptional>>This <<var;name="work";words="1-3">> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License"""
CC_SHORT = """Licensed under <<beginOptional>>the<<endOptional>> CC %s 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>"""
CC_LONG = """Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution%s 4.0 International License"""
CC_PARTS = {"BY": "", "BY-NC": "-NonCommercial", "BY-SA": "-ShareAlike", "BY-ND": "-NoDerivatives", "BY-NC-SA": "-NonCommercial-ShareAlike",
            "BY-NC-ND": "-NonCommercial-NoDerivatives"}
# ----------------------------------------------------------------------------------------------
TEMPLATES = (("mit", MIT), ("mit", MIT_LINE), ("isc", ISC), ("bsd-2-clause", BSD_HEAD + BSD_TAIL), ("bsd-3-clause", BSD_HEAD + BSD_NAMES + BSD_TAIL),
             ("apache-2.0", APACHE), *((f"gpl-{v}.0", text % v) for v in (2, 3) for text in (GPL_LINE, GPL_HEAD)),
             *((f"cc-{short.lower()}-4.0", CC_SHORT % short) for short in CC_PARTS), *((f"cc-{short.lower()}-4.0", CC_LONG % part) for short, part in CC_PARTS.items()))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r'<<(beginOptional|endOptional|var;[^<>]*?words="(\d+)-(\d+)"[^<>]*)>>')
#: Score of a document with base phrases only; an accepted template makes it 1.
BASE_SCORE = 0.5
#: Subset states an automaton keeps before it starts to make them anew.
KEEP_STATES = 50_000
_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
_IN_WORD = (_CODES >= 128) | ((_LOWER >= 97) & (_LOWER <= 122)) | ((_CODES >= 48) & (_CODES <= 57))


def ascii_words(text: str) -> list[str]:
    return WORD.findall(text.translate({k: k + 32 for k in range(65, 91)}))


def parsed(markup: str) -> list:
    """Words (str), replaceable regions ((fewest, most) words) and optional regions (lists of the same)."""
    stack: list[list] = [[]]
    at = 0
    for m in MARK.finditer(markup):
        stack[-1] += ascii_words(markup[at:m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append((int(m[2]), int(m[3])))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0] + ascii_words(markup[at:])


class Automaton:
    """Nondeterministic automaton over word numbers; sets of its states are bit masks."""

    ANY = -2

    def __init__(self, markup: str, number: dict[str, int]):
        self.on: list[tuple[int, int] | None] = []         # (word or ANY, next state)
        self.free: list[list[int]] = []                    # states reached without a word
        begin = self._state()
        self.end = self._chain(begin, parsed(markup), number)
        self._reach: dict[int, int] = {}
        self.start = self._closed({begin})
        self.forget()
        if self.start >> self.end & 1:
            raise ValueError("a template needs a mandatory word")
        if self._words(self.start) is None:
            raise ValueError("a template cannot begin with a replaceable region")

    def _state(self) -> int:
        self.on.append(None)
        self.free.append([])
        return len(self.on) - 1

    def _step(self, at: int, word: int) -> int:
        to = self._state()
        self.on[at] = (word, to)
        return to

    def _chain(self, at: int, parts: list, number: dict[str, int]) -> int:
        for part in parts:
            if isinstance(part, str):
                at = self._step(at, number[part])
            elif isinstance(part, tuple):
                fewest, most = part
                ways = [at] if not fewest else []
                for k in range(1, most + 1):
                    at = self._step(at, self.ANY)
                    if k >= fewest:
                        ways.append(at)
                after = self._state()
                for w in ways:
                    self.free[w].append(after)
                at = after
            else:
                inside, after = self._state(), self._state()
                self.free[at] += [inside, after]
                self.free[self._chain(inside, part, number)].append(after)
                at = after
        return at

    def _closed(self, states: set[int]) -> int:
        todo, mask = list(states), 0
        while todo:
            s = todo.pop()
            if not mask >> s & 1:
                mask |= 1 << s
                todo += self.free[s]
        return mask

    def _members(self, mask: int) -> list[int]:
        out = []
        while mask:
            out.append((mask & -mask).bit_length() - 1)
            mask &= mask - 1
        return out

    def _words(self, mask: int) -> set[int] | None:
        """Words that lead on from a set of states; None if any does."""
        words = {self.on[s][0] for s in self._members(mask) if self.on[s]}
        return None if self.ANY in words else words

    def forget(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def step(self, mask: int, word: int) -> int:
        to = self.known.get((mask, word))
        if to is None:
            to = self._closed({self.on[s][1] for s in self._members(mask) if self.on[s] and self.on[s][0] in (word, self.ANY)})
            if len(self.known) >= KEEP_STATES:
                self.forget()
            self.known[mask, word] = to
        return to

    def begins(self) -> list[tuple[int, int | None]]:
        """The first two words of accepted runs; None where any second word, or none, is possible."""
        out = []
        for first in sorted(self._words(self.start)):
            mask = self.step(self.start, first)
            seconds = self._words(mask)
            out += [(first, None)] if seconds is None or mask >> self.end & 1 else [(first, w) for w in sorted(seconds)]
        return out

    def longest(self, words: list[int], at: int, stop: int) -> int:
        """Where the longest accepted run from ``at`` ends, -1 without one."""
        mask, found = self.start, -1
        while at < stop and mask:
            mask = self.step(mask, words[at])
            at += 1
            if mask >> self.end & 1:
                found = at
        return found


class Scanner:
    """All templates and base phrases over blocks of documents."""

    def __init__(self, templates, base):
        words = sorted({w for phrase, _ in base for w in phrase.split()} | {w for _, markup in templates for w in ascii_words(MARK.sub(" ", markup))})
        self.vocabulary = pa.array([w.encode() for w in words], pa.binary())
        number = {w: k for k, w in enumerate(words)}
        self.base = [([number[w] for w in phrase.split()], label) for phrase, label in base]
        self.automata = [(label, Automaton(markup, number)) for label, markup in templates]
        # one table of where automata may start: first word, second word (-1: any), automaton
        self.begins = np.array([(a, -1 if b is None else b, k) for k, (_, auto) in enumerate(self.automata) for a, b in auto.begins()], np.int64).reshape(-1, 3)

    def words(self, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(byte where each word starts, its number or -1) of a buffer."""
        data = np.frombuffer(body, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _IN_WORD[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        packed = _LOWER[data[inside[1:-1]]]
        column = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        return start, pc.index_in(column, value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64)

    def scan(self, ends: np.ndarray, body: bytes) -> list[tuple]:
        """(n_words, base places as (word, label), spans as (label, first word, word behind)) of each document."""
        start, word = self.words(body)
        first = np.append(np.searchsorted(start, starts_of(ends)), len(start))
        document = np.repeat(np.arange(len(ends)), np.diff(first))
        known = np.append(np.flatnonzero(word >= 0), len(word))[:-1]        # places worth a look
        padded, owner = np.append(word, [-1] * 8), np.append(document, [-1] * 8)
        places: list[list] = [[] for _ in ends]
        for phrase, label in self.base:
            at = known[word[known] == phrase[0]]
            for k, w in enumerate(phrase[1:], 1):
                at = at[(padded[at + k] == w) & (owner[at + k] == owner[at])]
            for i, d in zip(at.tolist(), document[at].tolist(), strict=True):
                places[d].append((i - int(first[d]), label))
        spans: list[list] = [[] for _ in ends]
        for a, b, k in self.begins.tolist():
            at = known[word[known] == a]
            if b >= 0:
                at = at[(padded[at + 1] == b) & (owner[at + 1] == owner[at])]
            for i, d in zip(at.tolist(), document[at].tolist(), strict=True):
                label, auto = self.automata[k]
                # an automaton is over after as many words as it has states
                stop = min(int(first[d + 1]), i + len(auto.on))
                end = auto.longest(word[i:stop].tolist(), 0, stop - i)
                if end > 0:
                    spans[d].append((label, i - int(first[d]), i + end - int(first[d])))
        return [(int(n), sorted(p), outermost(s)) for n, p, s in zip(np.diff(first), places, spans, strict=True)]


def outermost(spans: list[tuple]) -> list[tuple]:
    """Spans by start, without those inside another of the same label."""
    out, reach = [], {}
    for label, a, b in sorted(set(spans), key=lambda s: (s[1], -s[2], s[0])):
        if b > reach.get(label, -1):
            reach[label] = b
            out.append((label, a, b))
    return out


OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
       "spans array<struct<label:string,first:long,behind:long>>")
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("behind", pa.int64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start, null without one), base_labels, labels (the templates' too), score and spans (the
    templates' places, by word).

    The score is 1 where a template accepts, ``BASE_SCORE`` with base phrases only, else 0.
    Null and empty texts have no words, no labels and score 0.  Whole texts are
    read and every row is judged by itself: repeated rows give equal rows, rows
    with a null id keep it, an empty table gives none.  Of places of one template
    inside each other the outermost is told.  Other columns of ``docs`` are not read.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for ids, ends, body in gather(batches):
            found = scanner.scan(ends, body)
            base_labels = [sorted({label for _, label in p}) for _, p, _ in found]
            labels = [sorted({*b, *(s[0] for s in spans)}) for b, (_, _, spans) in zip(base_labels, found, strict=True)]
            columns = [
                id_column(ids), pa.array([n for n, _, _ in found], pa.int64()), pa.array([len(p) for _, p, _ in found], pa.int64()),
                pa.array([p[0][0] if p else None for _, p, _ in found], pa.int64()), pa.array([p[-1][0] if p else None for _, p, _ in found], pa.int64()),
                pa.array(base_labels, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())),
                pa.array([1.0 if s else BASE_SCORE if p else 0.0 for _, p, s in found], pa.float64()),
                pa.array([[{"label": x, "first": a, "behind": b} for x, a, b in s] for _, _, s in found], _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, OUT)

