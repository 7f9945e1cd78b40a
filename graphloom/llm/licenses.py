"""Licence scan by a generalised suffix automaton of licence templates.

The automaton holds every word substring of all templates. A file's words stream through it
and give matching statistics: at each word, the longest template substring that ends there.
Right-maximal matches of MIN_MATCH words or more are chained along a template (template
positions rise, gaps in the file stay small); a chain that covers enough of its template is a
licence span. Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.
"""

from __future__ import annotations

from itertools import repeat

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import documents, map_texts

MIN_MATCH = 4
MAX_GAP = 12
COVERED = 0.6
#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Well-known grants and notices of public licences.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
)
#: Bytes that part words become spaces; A-Z becomes a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton; `ends[state]` lists the (template, end position) of its substrings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._add(last, token)
                self.ends[last].append((t, i))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The state below p for `token` whose longest substring is one longer than p's."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, self.next[last][token], token)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][token], token)
        return new

    def matches(self, tokens, least: int):
        """(start, length, state) of each match of >= least tokens that no next token extends."""
        state, length, out = 0, 0, []
        for i, token in enumerate(tokens):
            if token not in self.next[state]:
                if length >= least:
                    out.append((i - length, length, state))
                while state and token not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
        if length >= least:
            out.append((len(tokens) - length, length, state))
        return out


def make_scanner(templates=TEMPLATES, phrases=PHRASES):
    """Function of one text: (n_words, phrase places [(start, label)], spans [(label, start, end, covered)])."""
    import numpy as np

    sequences = [words_of(x) for _, x in templates]
    vocabulary = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s} | {w for p, _ in phrases for w in words_of(p)}), 1)}
    automaton = SuffixAutomaton([[vocabulary[w] for w in s] for s in sequences])
    wanted = [([vocabulary[w] for w in words_of(p)], label) for p, label in phrases]

    def chain(found):
        """Best chain of matches per template: {template: (covered words, first word, end)}."""
        by: dict[int, list] = {}
        for start, length, state in found:
            for t, end in automaton.ends[state]:
                by.setdefault(t, []).append((start, length, end - length + 1))
        best = []
        for t, own in by.items():
            own.sort()
            done: list[tuple] = []  # (covered, first word, end word, end in template)
            top = None
            for start, length, at in own:
                before = (0, start, start, -1)
                for c in reversed(done):
                    if start - c[2] > MAX_GAP + 2 * len(sequences[t]):
                        break
                    overlap = max(0, c[2] - start, c[3] - at)
                    if start - c[2] <= MAX_GAP and c[2] < start + length and c[3] < at + length and c[0] + length - overlap > before[0] + length:
                        before = (c[0] - overlap, c[1], c[2], c[3])
                now = (before[0] + length, before[1], start + length, at + length)
                done.append(now)
                if top is None or now[1] >= top[2] or now[0] > top[0]:
                    if top and now[1] >= top[2]:
                        best.append((t, top))
                    top = now
            best.append((t, top))
        return [(t, c[0] / len(sequences[t]), c[1], c[2]) for t, c in best if c[0] >= COVERED * len(sequences[t])]

    def scan(text: str | None):
        words = words_of(text)
        n = len(words)
        ids = np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, n)
        places = []
        for phrase, label in wanted:
            k = len(phrase)
            if n >= k:
                hit = ids[: n - k + 1] == phrase[0]
                for j in range(1, k):
                    hit &= ids[j : n - k + 1 + j] == phrase[j]
                places += [(int(i), label) for i in np.flatnonzero(hit)]
        known = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
        found = []
        for lo, hi in zip(known[::2].tolist(), known[1::2].tolist()):
            if hi - lo >= MIN_MATCH:
                found += [(lo + s, m, state) for s, m, state in automaton.matches(ids[lo:hi].tolist(), MIN_MATCH)]
        spans = [(templates[t][0], first, end, covered) for t, covered, first, end in chain(found)] if found else []
        return n, sorted(places), sorted(spans, key=lambda x: (x[1], x[2], x[0]))

    return scan


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and spans array<struct<label,first_word,end_word,covered>> of every row of `docs`.

    Null and empty texts have no words and no spans; rows without doc_id and repeated rows are
    kept; other columns are ignored.
    """

    def make():
        scan = make_scanner()

        def spans(text):
            n, _, found = scan(text)
            return n, [dict(zip(("label", "first_word", "end_word", "covered"), x)) for x in found]

        return spans

    return map_texts(docs, make, "n_words long, spans array<struct<label:string,first_word:int,end_word:int,covered:double>>")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places and licence labels of every row of documents."""

    def make():
        scan = make_scanner()

        def digest(text):
            n, places, spans = scan(text)
            base = {label for _, label in places}
            labels = base | {x[0] for x in spans}
            score = 1.0 if places else max((x[3] for x in spans), default=0.0)
            first, last = (places[0][0], places[-1][0]) if places else (None, None)
            return n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score)

        return digest

    return map_texts(
        documents(spark, sf_dir), make,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
