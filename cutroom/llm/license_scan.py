"""Licence scans with a generalised suffix automaton of licence words.

Templates are short notices, and the clauses of the whole licence texts in the folder `licenses` (file names are
LABEL__VERSION.txt): paragraphs, headings and other short ones joined to what follows. A clause that licences of
two families share word for word tells them not apart and is left to their other clauses.

The templates' words build one automaton. A text is streamed through it: after each word, the matching
statistic is the length of the longest run of words ending there that some template contains, and the
state's suffix links lead to all places in all templates where its last SEED words or more stand. So every
run of SEED words or more that the text shares with a template is found, whatever longer runs other
templates share. Runs are chained by dynamic programming, in order of text and template, at most GAP words
of text apart, into the span of the template that has most of its words; a span's coverage is the share of
the template's words it has. A label is given from COVERED on.

Beside it, the base phrases are looked for at every place; their labels stay whatever the spans say.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null counts as empty: no words, no
labels (''), score 0. Repeated rows give repeated results, an empty table gives none; a very long text is
streamed whole, in one task; extra columns are ignored, whatever their names. Of chains that cover
equally much, the one that ends first counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import plain
from .words import ALNUM, Text, Words, pieces, windows

# Phrases that give a label wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices and opening clauses of public licences.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
FOLDER = Path(__file__).with_name("licenses")
#: Fewest words of a clause; shorter paragraphs belong to the next.
CLAUSE = 20
SEED = 3
COVERED = 0.8
#: Most words between two runs of one span.
GAP = 20


def clauses_of(text: str) -> list[str]:
    """Paragraphs of a licence, without copyright lines; one of less than CLAUSE words is joined to the next, or at the end to the last."""
    out: list[str] = []
    open_ = ""
    for part in re.split(r"\n[ \t.]*\n", text.replace("\r", "")):
        if not plain(part) or len(plain(part)) < CLAUSE and re.match(r"\s*(portions )?copyright\b", part, re.I):
            continue
        open_ = f"{open_}\n{part.strip()}" if open_ else part.strip()
        if len(plain(open_)) >= CLAUSE:
            out.append(open_)
            open_ = ""
    if open_:
        out[-1:] = [f"{out[-1]}\n{open_}" if out else open_]
    return out


@cache
def clauses() -> tuple[tuple[str, str], ...]:
    """(label, clause) of all whole licence texts; once for each family, and none that two families share."""
    families: dict[tuple, dict[str, str]] = {}
    for path in sorted(FOLDER.glob("*.txt")):
        for clause in clauses_of(path.read_text(encoding="utf-8", errors="replace")):
            families.setdefault(tuple(plain(clause)), {}).setdefault(path.name.split("__")[0], clause)
    return tuple(next(iter(f.items())) for f in families.values() if len(f) == 1)


@cache
def _scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> "Scanner":
    """Built once in each worker process."""
    return Scanner(templates, dict(phrases))


class SuffixAutomaton:
    """Of several word sequences; ends[state]: every (template, place after the last word) where it stands."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, own)
                own[last].add((t, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            own[self.link[s]] |= own[s]
        self.ends = [sorted(x) for x in own]

    def _new(self, length: int, own: list, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        own.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: int, own: list) -> int:
        """The state of p's longest string and w, made anew if the one there stands for longer strings too."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, own, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, own: list) -> int:
        if w in self.next[last]:
            return self._split(last, w, own)
        new = self._new(self.length[last] + 1, own, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, own)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the length of the longest run ending there that some sequence has, and its state."""
        state, n = 0, 0
        for w in words:
            while state > 0 and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state, n = (self.next[state][w], n + 1) if w in self.next[state] else (0, 0)
            yield n, state

    def anchor(self, state: int, least: int) -> int:
        """The state on the suffix path that stands for the last `least` words: its ends are all places where those stand."""
        while self.length[self.link[state]] >= least:
            state = self.link[state]
        return state


@dataclass
class Span:
    template: int
    first: int
    last: int
    covered: int


@dataclass
class Scanner:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    seed: int = SEED

    def __post_init__(self) -> None:
        sequences = [self._hashes(text) for _, text in self.templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton([s.tolist() for s in sequences])
        self.begins = np.cumsum([0, *(len(x) for x in self.automaton.ends)])  # of each state's ends, in one list for all
        flat = np.array([p for x in self.automaton.ends for p in x], np.int64).reshape(-1, 2)
        self.of_template, self.after = flat[:, 0], flat[:, 1]
        seeds = [windows(s, self.seed) for s in sequences]
        self.seeds = np.unique(np.concatenate([*seeds, np.zeros(0, np.uint64)]))
        self.base = [(self._hashes(p), label) for p, label in self.phrases.items()]

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        data = b" ".join(plain(text))
        return Text(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64)).words(ALNUM, lower=True).hashes

    def places(self, words: Words) -> Iterator[tuple[int, str]]:
        """(first word, label) of each base phrase."""
        h, owner_end = words.hashes, words.bounds
        for phrase, label in self.base:
            n = len(h) - len(phrase) + 1
            if n <= 0:
                continue
            same = h[:n] == phrase[0]
            for k in range(1, len(phrase)):
                same &= h[k : k + n] == phrase[k]
            for i in np.flatnonzero(same).tolist():
                if i + len(phrase) <= owner_end[int(np.searchsorted(owner_end, i, side="right"))]:
                    yield i, label

    def _seeds(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places after which SEED or more words stand in a template, and the states of the last SEED of them. Texts are streamed only where SEED consecutive words stand in a template."""
        h, none = words.hashes, np.zeros(0, np.int64)
        if len(h) < self.seed or not len(self.seeds):
            return none, none
        keys = windows(h, self.seed)
        at = np.minimum(np.searchsorted(self.seeds, keys), len(self.seeds) - 1)
        hits = np.flatnonzero(self.seeds[at] == keys)
        owner = np.searchsorted(words.bounds, hits, side="right") - 1
        whole = hits + self.seed <= words.bounds[owner + 1]
        hits, owner = hits[whole], owner[whole]
        places, states = [], []
        for part in np.split(hits, np.flatnonzero((np.diff(hits) > self.seed) | (np.diff(owner) != 0)) + 1):
            if len(part):
                begin, end = int(part[0]), int(part[-1]) + self.seed
                for i, (n, state) in enumerate(self.automaton.statistics(h[begin:end].tolist()), begin + 1):
                    if n >= self.seed:
                        places.append(i)
                        states.append(self.automaton.anchor(state, self.seed))
        return np.array(places, np.int64), np.array(states, np.int64)

    def runs(self, words: Words) -> np.ndarray:
        """Rows (text, template, first word in the piece, first word in the template, length) of all longest runs of SEED or more words, in that order."""
        places, states = self._seeds(words)
        n = self.begins[states + 1] - self.begins[states]
        at = np.repeat(self.begins[states] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        x, y, t = np.repeat(places, n), self.after[at], self.of_template[at]
        text = np.searchsorted(words.bounds, x - 1, side="right") - 1
        order = np.lexsort((x, x - y, t, text))
        x, y, t, text = x[order], y[order], t[order], text[order]
        # seeds that follow each other on a diagonal are one run
        new = np.concatenate([np.ones(min(1, len(x)), bool), (np.diff(x) != 1) | (np.diff(y) != 1) | (np.diff(t) != 0) | (np.diff(text) != 0)])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(x))) + self.seed - 1
        out = np.stack([text[begin], t[begin], x[begin] - self.seed, y[begin] - self.seed, length], 1)
        return out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]

    def spans(self, words: Words) -> Iterator[tuple[int, Span]]:
        """(text, span): of each text and template, the best chain of each stretch of runs at most GAP words apart."""
        runs = self.runs(words)
        cuts = np.flatnonzero((np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)) + 1
        for group in np.split(runs, cuts):
            if len(group):
                text, template = group[0, :2].tolist()
                for first, last, covered in chains([tuple(r) for r in group[:, 2:].tolist()]):
                    yield text, Span(template, first, last, covered)


def chains(runs: list[tuple[int, int, int]], gap: int = GAP) -> Iterator[tuple[int, int, int]]:
    """(first word, last word, words covered) of the best chain of each stretch of runs (first in text, first in template, length), sorted by first.

    In a chain, text and template go on from run to run, and the text by at most gap words between them; what two
    runs share counts once.
    """
    longest = max(n for _, _, n in runs)
    stretch: list[tuple[int, int, int]] = []  # covered by the best chain ending in a run, last word, first word
    reach, lo = None, 0
    for k, (x, y, n) in enumerate(runs):
        if reach is not None and x - reach > gap:
            yield _best(stretch)
            stretch, lo = [], k
        best, begin = n, x
        while runs[lo][0] < x - gap - longest:
            lo += 1
        for j in range(lo, k):
            u, v, m = runs[j]
            shared = max(0, u + m - x, v + m - y)
            if u < x and v < y and shared < n and x - u - m <= gap:
                covered, _, start = stretch[j - (k - len(stretch))]
                if covered + n - shared > best:
                    best, begin = covered + n - shared, start
        stretch.append((best, x + n - 1, begin))
        reach = x + n if reach is None else max(reach, x + n)
    yield _best(stretch)


def _best(stretch: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    covered, last, first = max(stretch, key=lambda s: (s[0], -s[1], s[2]))
    return first, last, covered


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (first_word, label of each base phrase) and spans (label, first_word, last_word, coverage). No shuffle.

    Without templates: the notices and all clauses of the whole texts.
    """
    templates = TEMPLATES + clauses() if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, tuple(phrases.items()))
        for batch in batches:
            for lo, hi, text in pieces(batch.column(1)):
                words = text.words(ALNUM, lower=True)
                places: list[list[dict]] = [[] for _ in range(hi - lo)]
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                for i, label in scanner.places(words):
                    d = int(np.searchsorted(words.bounds, i, side="right")) - 1
                    places[d].append({"first_word": i - int(words.bounds[d]), "label": label})
                for d, s in scanner.spans(words):
                    b = int(words.bounds[d])
                    spans[d].append({"label": templates[s.template][0], "first_word": s.first - b, "last_word": s.last - b, "coverage": s.covered / scanner.sizes[s.template]})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(words.counts().astype(np.int64)),
                        pa.array(places, pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))),
                        pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))),
                    ],
                    names=["doc_id", "n_words", "places", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, places array<struct<first_word:bigint,label:string>>, spans array<struct<label:string,first_word:bigint,last_word:bigint,coverage:double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digest(rows: DataFrame, covered: float = COVERED) -> DataFrame:
    """scan's rows as counts, smallest and largest place, sorted labels and the best coverage."""
    base = F.transform("places", lambda p: p["label"])
    own = F.transform(F.filter("spans", lambda s: s["coverage"] >= covered), lambda s: s["label"])
    firsts = F.transform("places", lambda p: p["first_word"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
