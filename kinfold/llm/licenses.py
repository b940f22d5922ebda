"""License scans: a generalised suffix automaton of license words.

The automaton holds all template texts (a parameter of bounded size, built where it is used). A document's words are
streamed through it once; the state and match length at each word, and those of its suffix links, are the matching statistics
of every template. Matches of at least ``min_match`` words that cannot be extended at their place in a template, whether or not other
templates go on, are chained in order, so that changed or missing words only split a match; a chain's share of the template is its coverage. Short phrases are read off the same statistics:
a phrase ends at a word if its state is the current one or an ancestor of it.

Nulls and empty texts have no words: no labels, score 0. Overlapping places of phrases all count. Empty tables give no rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.text import letter_words, with_results

#: Phrase and its label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Wording of widely used licenses and notices, and the label of each.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("all rights reserved", "all-rights-reserved"),
)

_UNKNOWN = -2
#: Places that are looked at one by one; more are compared together.
_FEW = 24

MIN_MATCH = 5
COVERAGE = 0.7


class Automaton:
    """Minimal automaton of all runs of words of the added texts, with suffix links."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[bytes, int] = {}

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state that holds exactly the runs of q that p reaches by c."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: Sequence[bytes]) -> list[int]:
        """Adds a text; returns the state of each of its prefixes."""
        last, states = 0, []
        for w in words:
            c = self.ids.setdefault(w, len(self.ids))
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                self.link[new] = 0 if p == -1 else self._split(p, c, self.next[p][c])
                last = new
            states.append(last)
        return states


class LicenseScanner:
    def __init__(self, templates, phrases, min_match: int):
        auto = self.auto = Automaton()
        self.labels = [label for _, label in templates]
        self.sizes = [len(letter_words(t)) for t, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        self.min_match = min_match
        texts = [letter_words(t) for t, _ in templates]
        for words in texts:
            auto.add(words)
        phrase_words = [letter_words(p) for p, _ in phrases]
        for words in phrase_words:
            auto.add(words)
        # Adding may split states, so places are read by walking the finished automaton.
        own_ends, own_phrases = defaultdict(list), defaultdict(list)
        for t, words in enumerate(texts):
            after = [*map(auto.ids.get, words[1:]), -1]
            for end, state in enumerate(self._walk(words)):
                own_ends[state].append((t, end, after[end]))
        for p, words in enumerate(phrase_words):
            own_phrases[self._walk(words)[-1]].append((p, len(words)))
        order = sorted(range(1, len(auto.next)), key=lambda v: -auto.length[v])
        self._lay_out(own_ends)
        self.least = min((min(max(min_match, 1), n) for n in self.sizes if n), default=1)
        self.tails: list[tuple[tuple[int, int], ...]] = [()] * len(auto.next)
        for v in reversed(order):
            self.tails[v] = (*own_phrases.get(v, ()), *(self.tails[auto.link[v]] if auto.link[v] > 0 else ()))

    def _lay_out(self, own_ends: dict[int, list[tuple[int, int, int]]]) -> None:
        """Every place (template, last word, the word that follows it there) stands once, in the order of a walk over the tree of suffix links, so
        that the places of a state, which are also those of all states below it, are one range."""
        below = defaultdict(list)
        for v, up in enumerate(self.auto.link):
            if up >= 0:
                below[up].append(v)
        self.low, self.high = [0] * len(self.auto.next), [0] * len(self.auto.next)
        laid: list[tuple[int, int, int]] = []
        waiting = [(0, False)]
        while waiting:
            v, done = waiting.pop()
            if done:
                self.high[v] = len(laid)
                continue
            self.low[v] = len(laid)
            laid += own_ends.get(v, ())
            waiting.append((v, True))
            waiting += [(u, False) for u in below[v]]
        self.place = [(t, end) for t, end, _ in laid]
        self.after = np.array([after for *_, after in laid], np.int64)
        self.need = np.array([min(self.min_match, self.sizes[t]) for t, *_ in laid], np.int64)
        self.follows, self.least_size = self.after.tolist(), self.need.tolist()
        #: The word that follows all places of a state, or none.
        turns = np.concatenate([[0], np.cumsum(self.after[1:] != self.after[:-1])]) if laid else np.zeros(0, np.int64)
        one = [hi > lo and turns[lo] == turns[hi - 1] for lo, hi in zip(self.low, self.high, strict=True)]
        self.only = [int(self.after[lo]) if same else None for lo, same in zip(self.low, one, strict=True)]

    def _walk(self, words: Sequence[bytes]) -> list[int]:
        state, out = 0, []
        for w in words:
            state = self.auto.next[state][self.auto.ids[w]]
            out.append(state)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Places (start, phrase), and the best chain per stretch: (template, first word, last word, coverage)."""
        arcs, link, length, tails, least = self.auto.next, self.auto.link, self.auto.length, self.tails, self.least
        places: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        v = size = 0
        for i, c in enumerate(map(self.auto.ids.get, words)):
            if size >= least:
                self._match(i - 1, v, size, c, matches)
            if c is None:
                v = size = 0
                continue
            if c not in arcs[v]:
                while v and c not in arcs[v]:
                    v = link[v]
                size = length[v] if v else 0
            if c in arcs[v]:
                v, size = arcs[v][c], size + 1
                while v and length[link[v]] >= size:
                    v = link[v]
                for p, n in tails[v]:
                    if size >= n:
                        places.append((i - n + 1, p))
            else:
                v = size = 0
        self._match(len(words) - 1, v, size, None, matches)
        return places, [span for t, found in matches.items() for span in self._chains(t, found)]

    def _match(self, at: int, v: int, size: int, c: int | None, matches) -> None:
        """Notes the matches of the words that end at ``at`` and do not go on with the word ``c``. A place in a template is met first at
        the longest run that it holds; its shorter runs follow along the suffix links. Where all places of a state go on with ``c``, as most do
        inside a template, none is looked at."""
        c = _UNKNOWN if c is None else c
        from_, to = -1, -1  # places met at a longer run
        while size >= self.least:
            low, high = self.low[v], self.high[v]
            if self.only[v] != c:
                for a, b in ((low, high),) if to < 0 else ((low, from_), (to, high)):
                    if b - a <= _FEW:
                        for k in range(a, b):
                            if self.follows[k] != c and self.least_size[k] <= size:
                                t, end = self.place[k]
                                matches[t].append((at - size + 1, end - size + 1, size))
                    else:
                        for k in (np.flatnonzero((self.after[a:b] != c) & (self.need[a:b] <= size)) + a).tolist():
                            t, end = self.place[k]
                            matches[t].append((at - size + 1, end - size + 1, size))
            from_, to, v = low, high, self.auto.link[v]
            size = self.auto.length[v]

    def _chains(self, t: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains matches that follow each other in the document and in the template, with less than a template's length between them."""
        total = self.sizes[t]
        found.sort()
        best: list[tuple[int, int]] = []  # words covered, first word of the chain
        low = 0
        spans = []
        for k, (doc, tpl, n) in enumerate(found):
            while found[low][0] + found[low][2] + total < doc:
                low += 1
            score, first = n, doc
            for j in range(low, k):
                d, p, m = found[j]
                if d < doc and p < tpl:
                    shared = max(0, d + m - doc, p + m - tpl)
                    if shared < n and best[j][0] + n - shared > score:
                        score, first = best[j][0] + n - shared, best[j][1]
            best.append((score, first))
            spans.append((first, doc + n - 1, min(1.0, score / total)))
        top: dict[int, tuple[int, float]] = {}
        for first, last, share in spans:
            if first not in top or share > top[first][1]:
                top[first] = (last, share)
        return [(t, first, last, share) for first, (last, share) in sorted(top.items())]


_SPANS = "array<struct<label:string,template:int,first:long,last:long,coverage:double>>"


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, coverage: float = COVERAGE, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns in ``keep``), ``n_words``, ``n_places``, ``first_place`` and ``last_place`` (phrases),
    ``place_labels``, ``spans`` (chains of at least ``coverage``) and ``best`` (the highest coverage of a template or phrase)."""

    fields = ["n_words", "n_places", "first_place", "last_place", "place_labels", "spans", "best"]
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span), pa.float64()]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = LicenseScanner(templates, phrases, min_match)
        for texts in batches:
            out: list[list] = [[] for _ in fields]
            for text in texts:
                words = letter_words(text.as_py())
                places, chains = scanner.scan(words)
                starts = [s for s, _ in places]
                spans = [{"label": scanner.labels[t], "template": t, "first": a, "last": b, "coverage": c} for t, a, b, c in chains if c >= coverage]
                values = (
                    len(words), len(places), min(starts, default=None), max(starts, default=None),
                    sorted({scanner.phrase_labels[p] for _, p in places}), spans,
                    1.0 if places else max((c for *_, c in chains), default=0.0),
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], fields)

    types = ["long"] * 4 + ["array<string>", _SPANS, "double"]
    returns = f"struct<{','.join(f'{n}:{t}' for n, t in zip(fields, types, strict=True))}>"
    return with_results(docs, keep, run, returns, F.col("text"))
