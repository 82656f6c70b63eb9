"""Licence scans by a generalised suffix automaton of licence notices.

The words of all notices make one automaton. A text is streamed through it: for each word the
longest run of words ending there that occurs in a notice (matching statistics). Runs that
can't be made longer are matches; matches of one notice that follow one another in the
text and in the notice, with at most MOST_GAP other words between, are chained to a span, and
a span that covers SHARE of its notice gives the notice's label. Words that tell licences apart (a version,
Lesser, Affero, NonCommercial) are marked in the notices: a span without one of them gives no label, nor does one
with other words where a notice's words have to stand together. Only stretches of words whose
pairs of neighbours occur in a notice are streamed; no other word can be in a match of two.

The base phrases are notices as well; where their words stand consecutively is counted apart.

Defined cases: a null text is an empty one; a text without words has no places, labels "" and
score 0; repeated rows are scanned each; ties of spans go to the earlier one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lidaraudit.llm.common import WordHasher, chunks, mapped, read_documents, runs

#: The contract's phrases.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of well-known public licences, in their usual wording. A word after `*` has to be there; words joined by `~` have to stand together.
NOTICES = {
    "agpl-3.0": ["under the terms of the GNU~*Affero~General Public License as published by the Free Software Foundation, either version~*3 of the License", "licensed under the GNU~*Affero~General Public License"],
    "apache-2.0": [
        "Licensed under the *Apache License, Version~*2~0", "Licensed under the *Apache License, Version~*2~0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "bsd-2-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the *BSD License", "Licensed under the *BSD License"],
    "bsd-3-clause": ["*Neither the name of the copyright holder nor the names of its contributors may be used to *endorse or *promote products derived from this software without specific prior written permission"],
    "bsd": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "cc0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the *public *domain worldwide", "licensed under *CC0 1.0 Universal"],
    "cc-by-4.0": ["Licensed under CC~BY~*4~0", "This work is licensed under a Creative Commons *Attribution~4~0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC~BY~*NC 4.0", "This work is licensed under a Creative Commons Attribution *NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC~BY~*SA 4.0", "This work is licensed under a Creative Commons Attribution *ShareAlike 4.0 International License"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the *Eclipse Public License 2.0"],
    "gpl-2.0": ["licensed under the GNU~General Public License, version~*2", "under the terms of the GNU~General Public License as published by the Free Software Foundation; either version~*2 of the License"],
    "gpl-3.0": ["licensed under the GNU~General Public License, version~*3", "under the terms of the GNU~General Public License as published by the Free Software Foundation, either version~*3 of the License"],
    "isc": ["Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": ["licensed under the GNU~*Lesser~General Public License", "under the terms of the GNU~*Lesser~General Public License as published by the Free Software Foundation"],
    "mit": [
        "Released under the *MIT License", "Licensed under the *MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the *Mozilla Public License, v. *2~0", "If a copy of the *MPL was not distributed with this file, You can obtain one at"],
    "unlicense": ["This is free and *unencumbered software released into the public domain"],
}
#: Bytes between words: the contract's class, before A-Z are lower-cased.
BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Characters of words of the notices.
WORD = "0-9A-Za-z"
MOST_GAP = 8
SHARE = 0.8

COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,share:double>>"


def words_of(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


def marks_of(notice: str) -> tuple[int, int]:
    """Which words of a notice have to be there, and which have to stand together with the next one, as bits."""
    needed = together = 0
    for i, (before, _) in enumerate(re.findall(rf"([^{WORD}]*)([{WORD}]+)", notice)):
        needed |= ("*" in before) << i
        together |= ("~" in before) << i >> 1
    return needed, together


class SuffixAutomaton:
    """Of several sequences; ends[v] has (sequence, place) of each occurrence of the runs of state v."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for s, sequence in enumerate(sequences):
            last = 0
            for i, t in enumerate(sequence):
                last = self._extend(last, t)
                self.ends[last].add((s, i))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, v: int, t: int) -> int:
        """The state of the runs of v followed by t, apart from longer ones that end alike."""
        w = self.next[v][t]
        if self.length[w] == self.length[v] + 1:
            return w
        copy = self._state(self.length[v] + 1, self.link[w], dict(self.next[w]))
        self.link[w] = copy
        while v >= 0 and self.next[v].get(t) == w:
            self.next[v][t] = copy
            v = self.link[v]
        return copy

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            return self._split(last, t)
        new, v = self._state(self.length[last] + 1, 0, {}), last
        while v >= 0 and t not in self.next[v]:
            self.next[v][t] = new
            v = self.link[v]
        if v >= 0:
            self.link[new] = self._split(v, t)
        return new

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the runs that can't be made longer, two words at least."""
        v = n = 0
        for i, t in enumerate(tokens):
            was = v, n
            while v and t not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if t in self.next[v]:
                v, n = self.next[v][t], n + 1
            if was[1] >= 2 and n <= was[1]:
                yield i - 1, was[1], was[0]
        if n >= 2:
            yield len(tokens) - 1, n, v


class Scanner:
    def __init__(self, notices: dict[str, list[str]] = NOTICES, phrases: dict[str, str] = PHRASES, share: float = SHARE, gap: int = MOST_GAP) -> None:
        self.share, self.gap = share, gap
        texts = [(label, x) for label, own in notices.items() for x in own] + [(label, x) for x, label in phrases.items()]
        self.labels = [label for label, _ in texts]
        vocabulary = sorted({w for _, x in texts for w in words_of(x)})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.notices = [[number[w] for w in words_of(x)] for _, x in texts]
        self.marks = [marks_of(x) for _, x in texts]
        self.automaton = SuffixAutomaton(self.notices)
        self.phrases = [([number[w] for w in words_of(x)], label) for x, label in phrases.items()]
        self.hasher = WordHasher(BETWEEN)
        hashes = np.concatenate([self.hasher.words(np.frombuffer(w, np.uint8), np.array([len(w)]))[0] for w in vocabulary])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        n = len(vocabulary)
        self.pair = np.zeros((n + 1, n + 1), bool)  # n: any other word
        for x in self.notices:
            self.pair[x[:-1], x[1:]] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], len(self.hashes))

    def spans(self, stretches: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """Chains of one text: label, first and last word, share of the notice that is covered."""
        chains: dict[int, list[int]] = {}  # notice: first word, last word, end in the notice, words covered, pairs of neighbours covered
        found = []

        def close(s: int) -> None:
            first, last, _, covered, pairs = chains.pop(s)
            needed, together = self.marks[s]
            if covered.bit_count() >= 2 and covered & needed == needed and pairs & together == together:
                found.append((self.labels[s], first, last, covered.bit_count() / len(self.notices[s])))

        for begin, tokens in stretches:
            for i, n, state in self.automaton.matches(tokens):
                last = begin + i
                for s, end in sorted(self.automaton.ends[state]):
                    c, covered, pairs = chains.get(s), ((1 << n) - 1) << end - n + 1, ((1 << n - 1) - 1) << end - n + 1
                    if c and (last - n - c[1] > self.gap or end <= c[2]):
                        if end <= c[2] and last - n - c[1] <= self.gap and c[3].bit_count() >= n:
                            continue  # the chain is further on in the notice already
                        close(s)
                        c = None
                    if c:
                        c[1:] = last, end, c[3] | covered, c[4] | pairs
                    else:
                        chains[s] = [last - n + 1, last, end, covered, pairs]
        for s in list(chains):
            close(s)
        return sorted(found, key=lambda x: (x[1], -x[3], x[0]))

    def scan(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """For each text: n_words, places of base phrases, base labels, spans."""
        hashes, counts = self.hasher.words(data, ends)
        words, doc, upto = self.numbers(hashes), runs(counts), np.cumsum(counts)
        same = doc[1:] == doc[:-1]
        at = np.flatnonzero(self.pair[words[:-1], words[1:]] & same)
        places: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in self.phrases:
            n = len(words) - len(phrase) + 1
            if n > 0:
                hit = np.logical_and.reduce([words[k : n + k] == w for k, w in enumerate(phrase)]) & (doc[:n] == doc[len(phrase) - 1 :])
                for i in np.flatnonzero(hit).tolist():
                    places.setdefault(int(doc[i]), []).append((i, label))
        stretches: dict[int, list[tuple[int, list[int]]]] = {}
        for own in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else []:
            a, b = int(own[0]), int(own[-1]) + 2
            stretches.setdefault(int(doc[a]), []).append((a, words[a:b].tolist()))
        for d, n in enumerate(counts.tolist()):
            first = int(upto[d]) - n
            base = [(i - first, label) for i, label in places.get(d, [])]
            spans = self.spans([(a - first, x) for a, x in stretches[d]]) if d in stretches else []
            yield n, base, spans


def _rows(scanner: Scanner, doc_ids: list, column: pa.Array) -> Iterator[tuple]:
    for a, b, data, ends in chunks(column):
        for doc_id, (n, base, spans) in zip(doc_ids[a:b], scanner.scan(data, ends), strict=True):
            at, own = [i for i, _ in base], {label for _, label in base}
            labels = own | {label for label, _, _, share in spans if share >= scanner.share}
            yield doc_id, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), max((x[3] for x in spans), default=0.0), [dict(zip(("label", "first_word", "last_word", "share"), x, strict=True)) for x in spans if x[3] >= scanner.share]


def scan(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, phrases: dict[str, str] = PHRASES, share: float = SHARE, gap: int = MOST_GAP) -> DataFrame:
    """COLUMNS for each document; spans are the chains that give a label."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), kind]
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", COLUMNS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases, share, gap)
        for batch in batches:
            if batch.num_rows:
                rows = list(zip(*_rows(scanner, batch["doc_id"].to_pylist(), batch["text"]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    return docs.select("doc_id", "text").transform(mapped, work, COLUMNS)


def op7_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_documents(spark, sf_dir)).drop("spans")


QUERIES = {"op7_suffix_automaton": op7_suffix_automaton}
ORACLE: dict[str, str] = {}
