"""Operator 11. Licence scan by a generalised suffix automaton of licence tokens.

The automaton holds every run of words of all templates. A text streams through it word by word, which gives its matching statistics: at each word the longest run
ending there that some template has. Runs that no further word prolongs are the matches; those of at least ``least`` words are placed wherever templates have them, and
matches of one template that follow each other in both text and template are chained. A chain that covers ``share`` of its template is a span, and labels the text.
Phrases are short templates that must stand whole: one ends at a word if its state is on the suffix path of the word's state and the run is no shorter, so the same walk finds all their places.

The automaton is made on the driver and sent to the tasks, so the templates are bounded (``TEMPLATE_WORDS``; more raise an error). Texts are read whole, one row at a time; there
is no shuffle, so neither a frequent licence nor a hot source gathers anywhere.

Defined results: null and empty texts have no words, places or labels and the score 0; score is the largest share of a template that one chain covers (1 with any phrase); repeated rows
have their own rows; an empty table gives no rows; other columns are kept, and columns called as a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from itertools import compress, count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.words import as_bytes, words

TEMPLATE_WORDS = 200_000
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Label and text of the notices that are looked for, fixed values: the public wording of each licence.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
SPAN = "label string, start long, end long, covered long, size long"
RESULT = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<{SPAN.replace(' string', ':string').replace(' long', ':long')}>>"
NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


class SuffixAutomaton:
    """The states of all runs of words of some sequences. next, link, length: as usual; ends(state): (sequence, position) where the state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self.extend(last, word)
                own[last].append((s, i))
        # the runs of a state end wherever those of the states below it in the tree of links do: one slice of the tree's order
        below = defaultdict(list)
        for state, link in enumerate(self.link):
            below[link].append(state)
        self.first, self.end, self.places = [0] * len(self.link), [0] * len(self.link), []
        todo = [(0, True)]
        while todo:
            state, enters = todo.pop()
            if enters:
                self.first[state] = len(self.places)
                self.places += own[state]
                todo.append((state, False))
                todo += [(x, True) for x in below[state]]
            else:
                self.end[state] = len(self.places)

    def state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after), self.link.append(link), self.length.append(length)
        return len(self.link) - 1

    def split(self, last: int, word: int) -> int:
        """The state that last and word lead to, parted from the longer runs that it shares a state with."""
        old = self.next[last][word]
        if self.length[old] == self.length[last] + 1:
            return old
        own = self.state(self.length[last] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = own
        while last >= 0 and self.next[last].get(word) == old:
            self.next[last][word] = own
            last = self.link[last]
        return own

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self.split(last, word)
        own = self.state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = own
            last = self.link[last]
        if last >= 0:
            self.link[own] = self.split(last, word)
        return own

    def ends(self, state: int) -> list[tuple[int, int]]:
        return self.places[self.first[state] : self.end[state]]

    def find(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


class LicenceScanner:
    """templates, phrases: (label, text) and (text, label). least: words of a match that is chained; gap: words of the text between two matches of a chain; share: of a template that a span covers."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, least: int = 3, gap: int = 8, share: float = 0.8):
        texts = [words(t.encode()) for _, t in templates] + [words(p.encode()) for p, _ in phrases]
        if sum(map(len, texts)) > TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {TEMPLATE_WORDS} words")
        self.least, self.gap, self.share = least, gap, share
        self.word = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        coded = [[self.word[w] for w in t] for t in texts]
        self.labels, self.sizes = [label for label, _ in templates], [len(t) for t in coded[: len(templates)]]
        self.automaton = SuffixAutomaton(coded)
        own = defaultdict(list)
        for (_, label), sequence in zip(phrases, coded[len(templates) :], strict=True):
            if sequence:
                own[self.automaton.find(sequence)].append((len(sequence), label))
        #: of each state, the phrases on its suffix path
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[state] = own[state] + self.phrases[self.automaton.link[state]]

    def matches(self, known: list[int | None]) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
        """(end, length, state) of the runs that no further word prolongs, and (start, label) of the phrases."""
        after, link, length_of, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        found, places = [], []
        state = length = 0
        before = -2
        there = [w is not None for w in known]
        for i, word in zip(compress(count(), there), compress(known, there), strict=True):
            if i != before + 1:
                if length >= self.least:
                    found.append((before, length, state))
                state = length = 0
            elif word not in after[state]:
                if length >= self.least:
                    found.append((before, length, state))
                while state and word not in after[state]:
                    state = link[state]
                    length = length_of[state]
            before = i
            if word in after[state]:
                state, length = after[state][word], length + 1
            for size, label in phrases[state]:
                if size <= length:
                    places.append((i - size + 1, label))
        if length >= self.least:
            found.append((before, length, state))
        return found, places

    def chains(self, found: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """Of each template: (covered, start, end) of the best chain that ends with each match."""
        at = defaultdict(list)
        for end, length, state in found:
            for template, place in self.automaton.ends(state):
                if template < len(self.sizes):
                    at[template].append((end, place, length))
        out = {}
        for template, own in at.items():
            own.sort()
            made: list[tuple[int, int, int, int]] = []  # end in text, end in template, covered, start
            oldest = 0
            for end, place, length in own:
                first = end - length + 1
                while oldest < len(made) and made[oldest][0] < first - 1 - self.gap:
                    oldest += 1
                covered, start = length, first
                for e, p, c, s in made[oldest:]:
                    shared = max(e - first + 1, p - (place - length), 0)
                    if e < end and p < place and shared < length and (c + length - shared, s) > (covered, start):
                        covered, start = c + length - shared, s
                made.append((end, place, covered, start))
            out[template] = [(c, s, e) for e, _, c, s in made]
        return out

    def scan(self, text: bytes) -> tuple:
        """The values of RESULT for one text."""
        own = words(text)
        found, places = self.matches(list(map(self.word.get, own)))
        spans, score = [], float(bool(places))
        for template, chains in self.chains(found).items():
            size, taken = self.sizes[template], []
            score = max(score, max(c for c, _, _ in chains) / size)
            for covered, start, end in sorted(chains, key=lambda x: (-x[0], x[1], x[2])):
                if covered < self.share * size:
                    break
                k = bisect_left(taken, (start, end))  # the spans of a template do not overlap
                if (k == 0 or taken[k - 1][1] < start) and (k == len(taken) or taken[k][0] > end):
                    insort(taken, (start, end))
                    spans.append((self.labels[template], start, end, covered, size))
        base = {label for _, label in places}
        starts = [s for s, _ in places]
        return (
            len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {s[0] for s in spans})), min(score, 1.0), sorted(set(spans), key=lambda s: (s[1], s[2], s[0], s[4])),
        )


def licence_scan(docs: DataFrame, scanner: LicenceScanner | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first and last word, words covered, words of the template)."""
    own = scanner or LicenceScanner()
    kind = pa.struct([("label", pa.string()), *((n, pa.int64()) for n in ("start", "end", "covered", "size"))])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(kind)]

    @F.arrow_udf(RESULT)
    def scan(text: pa.Array) -> pa.Array:
        columns = list(zip(*map(own.scan, as_bytes(text)), strict=True)) or [()] * len(kinds)
        columns[-1] = [[dict(zip(("label", "start", "end", "covered", "size"), s, strict=True)) for s in spans] for spans in columns[-1]]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields=[pa.field(n, k) for n, k in zip(NAMES, kinds, strict=True)])

    kept = [c for c in docs.columns if c.lower() not in NAMES]
    name = "found"
    while name in kept:
        name = "_" + name
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(*(F.col(f"`{c}`") for c in kept), scan(text).alias(name)).select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"{name}.{n}").alias(n) for n in NAMES))
