"""Licence scans by a generalised suffix automaton over the words of licence texts.

The automaton holds every template and every short phrase. A document's words are streamed through it; at each
place it gives the longest stretch ending there that some template contains (the matching statistics). Stretches
that can't grow become anchors, anchors that follow each other in a template and in the document are chained, and
a chain that covers enough of its template is a span with that template's label. A phrase is found where the
matching statistics reach a state whose suffix chain holds the phrase.

The automaton depends on the templates, phrases and settings only, all of which a caller may give, and is built once in each worker process.
Documents are read once; nothing is shuffled. Words are turned into numbers a part of a text at a time, so that a long text takes four bytes a word.

Cases: a null or empty text has no words, no label and score 0; long texts are scanned whole; a template of fewer words than an anchor, or a phrase of fewer than two, raises; of
places where a template fits as well, the first in the template counts; a null id is carried; repeated rows and other columns
don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import kept, parts_at_spaces, small_batches, start_task, utf8

#: Lower-cases A-Z and turns every byte that isn't part of a word into a space; bytes of other scripts are kept.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases that give a label by themselves.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices and opening passages of public licences, as (label, text).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "released under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "licensed under the BSD license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "licensed under the Apache License version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "this work is licensed under the GNU General Public License version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Up to so many different words in templates, pairs are looked up in a table.
TABLE_WORDS = 4096
SPAN = "struct<label:string,template:int,first_word:long,last_word:long,coverage:double>"
SCANNED = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Settings:
    """min_match: words of an anchor; max_gap: words between chained anchors; min_coverage: share of a template's words
    that a chain must match, short_coverage the same for templates of at most short_words words."""

    min_match: int = 3
    max_gap: int = 25
    min_coverage: float = 0.6
    short_words: int = 12
    short_coverage: float = 0.99


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the end places of each state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((k, i))
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(out)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the part of q that p leads to."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known stretch that ends at each word."""
        v = n = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            v = self.next[v].get(word, 0)
            n = n + 1 if v else 0
            yield v, n


class LicenseScanner:
    def __init__(self, templates=TEMPLATES, phrases=None, settings: Settings = Settings()):
        phrases = BASE_PHRASES if phrases is None else phrases
        self.settings = settings
        self.labels = [label for label, _ in templates]
        split = [words_of(text.encode()) for _, text in templates]
        base = [words_of(p.encode()) for p in phrases]
        self.ids: dict[bytes, int] = {}
        for words in (*split, *base):
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        coded = [[self.ids[w] for w in words] for words in (*split, *base)]
        if any(len(words) < settings.min_match for words in split) or any(len(words) < 2 for words in base):
            raise ValueError(f"a template has at least {settings.min_match} words and a phrase two")
        self.sizes = [len(c) for c in coded[: len(split)]]
        self.automaton = SuffixAutomaton(coded)
        #: Pairs of words that follow each other in a template, as one number each: longer matches lie within runs of such pairs.
        self.size = len(self.ids) + 1
        self.follows = np.unique(np.concatenate([np.asarray(c[:-1], np.int64) * self.size + c[1:] for c in coded]))
        self.table = np.zeros(self.size**2 if self.size <= TABLE_WORDS else 0, bool)
        if len(self.table):
            self.table[self.follows] = True
        #: For each state, the phrases on its suffix chain: (words, label).
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.automaton.length)
        ends = {}
        for c, label in zip(coded[len(split) :], phrases.values(), strict=True):
            *_, (v, _) = self.automaton.statistics(c)
            ends.setdefault(v, []).append((len(c), label))
        for v in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[v] = (*self.phrases[self.automaton.link[v]], *ends.get(v, ()))

    def scan(self, text: bytes) -> dict:
        ids = self._coded(text)
        base: list[tuple[int, str]] = []
        anchors: list[tuple[int, int, int]] = []  # first word, words, state
        if len(ids) > 1:
            pairs = np.flatnonzero(self._known(ids[:-1].astype(np.int64) * self.size + ids[1:]))
            for run in np.split(pairs, np.flatnonzero(np.diff(pairs) > 1) + 1) if len(pairs) else ():
                self._stream(int(run[0]), ids[run[0] : run[-1] + 2].tolist(), base, anchors)
        spans = self._chain(anchors)
        best = max((s[4] for s in spans), default=0.0)
        settings = self.settings
        spans = [s for s in spans if s[4] >= (settings.short_coverage if self.sizes[s[1]] <= settings.short_words else settings.min_coverage)]
        base_labels = sorted({label for _, label in base})
        starts = [at for at, _ in base]
        return {
            "n_words": len(ids), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(base_labels),
            "labels": ",".join(sorted({*base_labels, *(s[0] for s in spans)})), "score": 1.0 if base else min(1.0, best),
            "spans": [dict(zip(("label", "template", "first_word", "last_word", "coverage"), s, strict=True)) for s in spans],
        }

    def _known(self, pairs: np.ndarray) -> np.ndarray:
        if len(self.table):
            return self.table[pairs]
        return self.follows[np.minimum(np.searchsorted(self.follows, pairs), len(self.follows) - 1)] == pairs

    def _coded(self, text: bytes) -> np.ndarray:
        """The number of each word, 0 for those that no template has."""
        parts = [words_of(part) for part in parts_at_spaces(text)]
        return np.concatenate([np.empty(0, np.int32), *(np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words)) for words in parts)])

    def _stream(self, at: int, ids: list[int], base: list, anchors: list) -> None:
        least = self.settings.min_match
        before = (0, 0)
        for i, (v, n) in enumerate(self.automaton.statistics(ids)):
            base += [(at + i + 1 - k, label) for k, label in self.phrases[v] if k <= n]
            if n <= before[1] and before[1] >= least:
                anchors.append((at + i - before[1], before[1], before[0]))
            before = (v, n)
        if before[1] >= least:
            anchors.append((at + len(ids) - before[1], before[1], before[0]))

    def _chain(self, anchors: list[tuple[int, int, int]]) -> list[tuple]:
        """Spans (label, template, first word, last word, coverage), by template and place."""
        open_: dict[int, list] = {}  # template: first word, last word, last place in the template, words matched
        done: list[tuple] = []

        def close(k: int) -> None:
            first, last, _, matched = open_.pop(k)
            done.append((self.labels[k], k, first, last, matched / self.sizes[k]))

        for at, n, v in anchors:
            for k, end in sorted(set(self.automaton.ends[v])):
                if k >= len(self.sizes):
                    continue
                begin = end - n + 1
                if (c := open_.get(k)) and begin > c[2] and c[1] < at <= c[1] + self.settings.max_gap:
                    c[1:] = at + n - 1, end, c[3] + n
                elif c and at <= c[1]:  # another place for words that the chain has, or an overlapping anchor
                    if (grown := at + n - 1 - c[1]) > 0 and end - grown >= c[2]:
                        c[1:] = at + n - 1, end, c[3] + grown
                else:
                    if c:
                        close(k)
                    open_[k] = [at, at + n - 1, end, n]
        for k in list(open_):
            close(k)
        return sorted(done, key=lambda s: (s[1], s[2]))


def scanner_of(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], settings: Settings) -> LicenseScanner:
    """This worker's scanner, kept from task to task."""
    start_task("licenses")
    return kept("licenses", (templates, phrases, settings), lambda: LicenseScanner(templates, dict(phrases), settings))


def scan_documents(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] | None = None
) -> DataFrame:
    """Phrases, labels and spans of each document (SCANNED); places are counted in words from 0. `templates` are (label, text), `phrases` have
    their labels; a span's template is its place in `templates`."""
    known = tuple((label, text) for label, text in templates), tuple((BASE_PHRASES if phrases is None else phrases).items()), settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(*known)
        span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}
        for batch in batches:
            rows = [scanner.scan(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())], ["doc_id", *kinds])

    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SCANNED)
