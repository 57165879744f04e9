"""Licence scans: matching statistics of whole texts against a generalised suffix automaton of licence words, chained into spans.

One automaton holds the words of all templates: every run of words that occurs in any of them is a path from its root. A
text is streamed through it once, and after each word the automaton knows the longest run, ending there, that some template
holds. Base phrases are found by their states on the way. Runs of ``MIN_MATCH`` words and more, where they can grow no
further, are chained for each template that holds them: the next run must go on later in the template and start within
``MAX_GAP`` words in the text, else the chain ends and another begins. A chain that covers ``COVER`` of its template's
words is a span and gives the template's label.

Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. Each text is read by itself, in one pass;
memory is that of one text and of the automaton, whose states are at most twice the templates' words.

- A null text is empty: no words, no labels ('' in both), null first and last words, score 0.
- Rows may repeat, and ids may be null or repeat: every row is scanned and returned. Other columns are not read.
- Very long texts and words are read whole. A run that several templates hold counts for each of them.
- ``score`` is the largest covered share of a template: 1 where a base phrase stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import table

#: Base phrases and their labels (fixed values).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices and texts of public licences (fixed values): label and words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
#: Words of the shortest run that chains use, words of a text that may lie between two runs, and the covered share that makes a span.
MIN_MATCH, MAX_GAP, COVER = 4, 20, 0.8

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Bytes of words, in lower case; a blank for every other byte.
_BYTES = bytes(c if c >= 128 or bytes([c]) in [bytes([k]) for k in _KEEP] else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def split(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.translate(_BYTES).split()


class Span(NamedTuple):
    """Words ``start`` to ``end`` (not included) of a text, of which ``covered`` chain into a share of a template."""

    label: str
    template: int
    start: int
    end: int
    covered: int
    share: float


class Automaton:
    """A generalised suffix automaton of word sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: For each state, where its runs end in each sequence that holds them, in order: {sequence: positions}.
        self.ends: list[dict[int, list[int]]] = [{}]
        for number, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                state = last
                while state > 0:
                    self.ends[state].setdefault(number, []).append(at)
                    state = self.link[state]

    def _state(self, size: int, link: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.ends.append({} if like is None else {k: list(v) for k, v in self.ends[like].items()})
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A state for what ``state`` and ``word`` spell, where ``target`` also has longer runs."""
        twin = self._state(self.size[state] + 1, self.link[target], target)
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        self.link[target] = twin
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        target = self.next[last].get(word)
        if target is not None:  # another sequence has spelt it already
            return target if self.size[target] == self.size[last] + 1 else self._split(last, word, target)
        new, state = self._state(self.size[last] + 1, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.size[target] == self.size[state] + 1 else self._split(state, word, target)
        return new

    def find(self, words: list[bytes]) -> int:
        """The state of a run of words that some sequence holds."""
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length): the longest run ending at each word that has one; the words that have none are left out."""
        state, length, following, link, size = 0, 0, self.next, self.link, self.size
        known = following[0]
        for at, w in enumerate(words):
            if w not in known:
                state = length = 0
                continue
            to = following[state].get(w)
            while to is None:
                state = link[state]
                length = size[state]
                to = following[state].get(w)
            state, length = to, length + 1
            yield at, state, length


class Scanner:
    """Templates, base phrases and their automaton."""

    def __init__(self, base: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]):
        phrases, notices = [split(p.encode()) for p, _ in base], [split(t.encode()) for _, t in templates]
        self.base, self.templates = base, templates
        self.sizes = [len(n) for n in notices]
        self.automaton = a = Automaton(notices + phrases)
        own: dict[int, list[tuple[int, int]]] = {}
        for number, p in enumerate(phrases):
            own.setdefault(a.find(p), []).append((number, len(p)))
        #: For each state, the base phrases (number, words) that end where its runs end.
        self.phrases: list[list[tuple[int, int]]] = []
        for state in range(len(a.size)):
            found, up = [], state
            while up > 0:
                found += own.get(up, [])
                up = a.link[up]
            self.phrases.append(found)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Span], float]:
        """The places (start, phrase) of base phrases, the spans, and the largest covered share of a template."""
        places: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []
        phrases = self.phrases
        last = (-2, 0, 0)
        for at, state, length in self.automaton.stream(words):
            if last[2] >= MIN_MATCH and (at > last[0] + 1 or length <= last[2]):
                runs.append(last)
            last = (at, state, length)
            if phrases[state]:
                places += [(at - size + 1, number) for number, size in phrases[state] if size <= length]
        if last[2] >= MIN_MATCH:
            runs.append(last)
        spans, best = self._chained(runs)
        return places, spans, 1.0 if places else best

    def _chained(self, runs: list[tuple[int, int, int]]) -> tuple[list[Span], float]:
        spans: list[Span] = []
        best = 0.0
        open_: dict[int, list[int]] = {}  # template: start, end, end in the template, covered words

        def close(template: int) -> None:
            nonlocal best
            start, end, _, covered = open_.pop(template)
            share = covered / self.sizes[template]
            best = max(best, share)
            if share >= COVER:
                spans.append(Span(self.templates[template][0], template, start, end, covered, share))

        for at, state, length in runs:
            start, end = at - length + 1, at + 1
            for template, ended in self.automaton.ends[state].items():
                if template >= len(self.sizes):
                    continue
                if template in open_:
                    chain = open_[template]
                    for last in ended:  # the first place in the template where the run goes on
                        over = max(chain[1] - start, chain[2] - (last - length + 1), 0)  # words that the chain has already
                        if over < length and start + over - chain[1] <= MAX_GAP:
                            chain[1:] = [end, last + 1, chain[3] + length - over]
                            break
                    else:
                        close(template)
                if template not in open_:
                    open_[template] = [start, end, ended[0] + 1, length]
        for template in list(open_):
            close(template)
        return sorted(spans, key=lambda s: (s.start, s.end, s.template)), best


@lru_cache(maxsize=4)
def scanner(base: tuple[tuple[str, str], ...] = BASE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Scanner:
    return Scanner(base, templates)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[list[bytes]]]]:
    for b in batches:
        texts = b.column("text").cast(pa.binary() if pa.types.is_string(b.column("text").type) else pa.large_binary())
        yield b, (split(t.as_py() or b"") for t in texts)


def scan(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans), one for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(base, templates)
        for b, texts in _texts(batches):
            rows = []
            for words in texts:
                places, spans, score = s.scan(words)
                starts = [at for at, _ in places]
                named = {base[number][1] for _, number in places}
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(named | {x.label for x in spans})), min(score, 1.0), len(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_spans bigint")


def spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Rows (doc_id, label, template, start, end, covered, share): every span of every document, in words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner((), templates)
        for b, texts in _texts(batches):
            found = [(at, x) for at, words in enumerate(texts) for x in s.scan(words)[1]]
            ids = b.column("doc_id").take(pa.array([at for at, _ in found], pa.int64()))
            kinds = dict(label=pa.string(), template=pa.int64(), start=pa.int64(), end=pa.int64(), covered=pa.int64(), share=pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([getattr(x, c) for _, x in found], k) for c, k in kinds.items()]], ["doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, label string, template bigint, start bigint, end bigint, covered bigint, share double")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and labels."""
    return scan(table(spark, sf_dir, "documents"))
