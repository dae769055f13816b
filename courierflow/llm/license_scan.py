"""License scan with a generalised suffix automaton of licence words.

The words of all template notices and phrases go into one suffix automaton
(small and fixed: a few hundred states), which every task builds for itself.
A document's words stream through it and give matching statistics: at each
word, the longest run ending there that occurs in some template.  Matches that
cannot grow are anchors (document position, template position, length);
anchors that go forward in both and leave small gaps are chained, and a chain
that covers enough of a template is a span.  Where spans overlap, the one with
the most matched words stays (then the better covered, the earlier, the smaller label):
a notice of one licence that differs from another's by a word counts once.  A
paragraph that several licences share takes the label of the nearest span
of one of them, else the first of them.  Phrases are read off the same
automaton: a phrase ends at a word when its state lies on the suffix-link path
of the current match.

Words are split and hashed for a whole Arrow buffer at once; only runs of
words whose neighbouring pairs occur in a template reach the automaton, which
is where any match of two or more words must lie.  No shuffle, no state
between rows, texts of any length.

Defined cases: null or empty text has no words, zero counts, null positions,
empty labels and score 0; repeated rows are scanned each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.common import buffers, text_of, word_chunks, word_hash

#: Fixed values of the contract: phrase, label.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Widely used licence notices, as their publishers word them.
#: A label of several words is a paragraph that these licences share.
NOTICES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as "
             "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
               "you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
               "basis without warranties or conditions of any kind either express or implied"),
    ("apache", "licensed under the apache license version 2 0"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
              "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to "
              "prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
            "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
              "from this software without specific prior written permission"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl agpl lgpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
                      "of merchantability or fitness for a particular purpose"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
            "the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties "
            "of merchantability and fitness"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
             "published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
             "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit boost", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                  "merchantability fitness for a particular purpose"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
                  "or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial "
                  "and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
             "arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
             "redistribute it freely"),
]

MIN_MATCH = 3
MAX_GAP = 8
MIN_COVERAGE = 0.7


@dataclass
class _State:
    length: int
    link: int = -1
    go: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (template, index of last word)
    phrases: list[tuple[int, int]] = field(default_factory=list)  # (phrase, its length) ending in this state or on its links


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of small integers."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.states = [_State(0)]
        for number, seq in enumerate(sequences):
            last = 0
            for i, symbol in enumerate(seq):
                last = self._extend(last, symbol)
                self.states[last].ends.append((number, i))
        for v in sorted(range(1, len(self.states)), key=lambda v: -self.states[v].length):
            up = self.states[v].link
            if up > 0:
                self.states[up].ends.extend(self.states[v].ends)
        for s in self.states:
            s.ends = sorted(set(s.ends))

    def _extend(self, last: int, symbol: int) -> int:
        st = self.states
        if symbol in st[last].go:
            q = st[last].go[symbol]
            return q if st[q].length == st[last].length + 1 else self._clone(last, symbol, q)
        new = len(st)
        st.append(_State(st[last].length + 1))
        p = last
        while p != -1 and symbol not in st[p].go:
            st[p].go[symbol] = new
            p = st[p].link
        if p == -1:
            st[new].link = 0
        else:
            q = st[p].go[symbol]
            st[new].link = q if st[q].length == st[p].length + 1 else self._clone(p, symbol, q)
        return new

    def _clone(self, p: int, symbol: int, q: int) -> int:
        st = self.states
        twin = len(st)
        st.append(_State(st[p].length + 1, st[q].link, dict(st[q].go)))
        st[q].link = twin
        while p != -1 and st[p].go.get(symbol) == q:
            st[p].go[symbol] = twin
            p = st[p].link
        return twin

    def find(self, seq: list[int]) -> int:
        v = 0
        for symbol in seq:
            v = self.states[v].go[symbol]
        return v

    def statistics(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match ending here) for each symbol."""
        st, v, length = self.states, 0, 0
        for symbol in seq:
            while v and symbol not in st[v].go:
                v = st[v].link
                length = st[v].length
            if symbol in st[v].go:
                v = st[v].go[symbol]
                length += 1
            yield v, length


class Scanner:
    """Automaton, vocabulary and chaining; built once per task."""

    def __init__(self, notices: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> None:
        self.labels = [label for label, _ in notices]
        self.phrase_labels = [label for _, label in phrases]
        words = sorted({w for _, t in notices for w in t.split()} | {w for t, _ in phrases for w in t.split()}, key=word_hash)
        self.hashes = np.array([word_hash(w) for w in words], np.uint64)
        number = {w: i for i, w in enumerate(words)}
        seqs = [[number[w] for w in t.split()] for t in [t for _, t in notices] + [t for t, _ in phrases]]
        self.sizes = [len(s) for s in seqs[:len(notices)]]
        self.automaton = SuffixAutomaton(seqs)
        self.pairs = np.zeros((len(words), len(words)), bool)
        for s in seqs:
            self.pairs[s[:-1], s[1:]] = True
        self.heads = {tuple(s[:2]) for s in seqs[len(notices):]}
        own: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(seqs[len(notices):]):
            own.setdefault(self.automaton.find(s), []).append((k, len(s)))
        for v in sorted(range(len(self.automaton.states)), key=lambda v: self.automaton.states[v].length):
            state = self.automaton.states[v]
            state.phrases = own.get(v, []) + (self.automaton.states[state.link].phrases if state.link > 0 else [])

    def runs(self, row: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(index of first word, vocabulary numbers) of the runs worth streaming."""
        if len(h) < 2:
            return
        near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[near] == h
        both = known[:-1] & known[1:] & (row[:-1] == row[1:])
        at = np.flatnonzero(both)
        at = at[self.pairs[near[at], near[at + 1]]]
        if not len(at):
            return
        new = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        for a, b in zip(at[new].tolist(), at[np.concatenate([new[1:], [len(at)]]) - 1].tolist()):
            seq = near[a:b + 2].tolist()
            if len(seq) >= MIN_MATCH or tuple(seq) in self.heads:
                yield a, seq

    def stream(self, first: int, seq: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrase places (phrase, start) and anchors (template, start, template start, length)."""
        st, places, anchors = self.automaton.states, [], []
        held = list(self.automaton.statistics(seq))
        for i, (v, length) in enumerate(held):
            places.extend((k, first + i + 1 - n) for k, n in st[v].phrases if n <= length)
            if length >= MIN_MATCH and (i + 1 == len(held) or held[i + 1][1] != length + 1):
                anchors.extend((t, first + i + 1 - length, end + 1 - length, length) for t, end in st[v].ends if t < len(self.sizes))
        return places, anchors

    def chain(self, anchors: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float, int]]:
        """Spans (label, first word, last word, coverage, matched words), the best non-overlapping ones of each template."""
        spans = []
        for t in sorted({a[0] for a in anchors}):
            mine = sorted((s, ts, n) for k, s, ts, n in anchors if k == t)
            best, back, start, low = [], [], [], 0
            for i, (s, ts, n) in enumerate(mine):
                cover, prev = n, -1
                while mine[low][0] + mine[low][2] + MAX_GAP + self.sizes[t] < s:
                    low += 1
                for j in range(low, i):
                    ps, pts, pn = mine[j]
                    lap = max(0, ps + pn - s, pts + pn - ts)  # words both anchors would claim
                    gap = max(s - ps - pn, ts - pts - pn)
                    if ps < s and pts < ts and lap < n and gap <= MAX_GAP and best[j] + n - lap > cover:
                        cover, prev = best[j] + n - lap, j
                best.append(cover)
                back.append(prev)
                start.append(start[prev] if prev >= 0 else s)
            found = sorted(((self.labels[t], start[i], mine[i][0] + mine[i][2] - 1, min(1.0, best[i] / self.sizes[t]), best[i]) for i in range(len(mine))),
                           key=lambda x: (-x[3], x[1], x[2]))
            spans.extend(_apart(found))
        return spans


def _apart(spans: list[tuple]) -> list[tuple]:
    """Spans that overlap none before them in the list, by place."""
    taken, edges = [], []
    for x in spans:
        k = bisect.bisect_right(edges, x[1])
        if (k == 0 or taken[k - 1][2] < x[1]) and (k == len(edges) or taken[k][1] > x[2]):
            edges.insert(k, x[1])
            taken.insert(k, x)
    return taken


def settle(spans: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float]]:
    """Spans (label, first word, last word, coverage) by place: the best of overlapping ones, with shared paragraphs labelled."""
    kept = _apart(sorted(spans, key=lambda s: (-s[4], -s[3], s[1], s[0])))
    places: dict[str, list[int]] = {}
    for label, first, *_ in kept:
        if " " not in label:
            places.setdefault(label, []).append(first)
    out = []
    for label, first, last, cover, _ in kept:
        choices = label.split()
        if len(choices) > 1:
            near = []
            for rank, c in enumerate(choices):
                at = places.get(c, [])
                k = bisect.bisect_right(at, first)
                near.extend((abs(first - p), rank) for p in at[max(0, k - 1):k + 1])
            label = choices[min(near)[1] if near else 0]
        out.append((label, first, last, cover))
    return out


_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>")
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))


def _scan(notices: list[tuple[str, str]], phrases: list[tuple[str, str]], min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for batch in batches:
            scanner = scanner or Scanner(notices, phrases)
            rows = batch.num_rows
            n_words, n_base = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            first, last, score = [None] * rows, [None] * rows, [0.0] * rows
            base, labels, spans = [""] * rows, [""] * rows, [[] for _ in range(rows)]
            for lo, hi, row, _, _, h in word_chunks(*buffers(batch.column(1))):
                n_words[lo:hi] = np.bincount(row - lo, minlength=hi - lo)
                begin = np.searchsorted(row, np.arange(lo, hi))
                found: dict[int, tuple[list, list]] = {}
                for at, seq in scanner.runs(row, h):
                    r = int(row[at])
                    places, anchors = scanner.stream(at - int(begin[r - lo]), seq)
                    if places or anchors:
                        held = found.setdefault(r, ([], []))
                        held[0].extend(places)
                        held[1].extend(anchors)
                for r, (places, anchors) in found.items():
                    own = {scanner.phrase_labels[k] for k, _ in places}
                    chained = scanner.chain(anchors)
                    kept = settle([s for s in chained if s[3] >= min_coverage])
                    if places:
                        n_base[r], first[r], last[r] = len(places), min(p for _, p in places), max(p for _, p in places)
                    base[r] = ",".join(sorted(own))
                    labels[r] = ",".join(sorted(own | {s[0] for s in kept}))
                    score[r] = max([0.0, *(s[3] for s in chained)])
                    spans[r] = [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                 pa.array(base), pa.array(labels), pa.array(score, pa.float64()), pa.array(spans, _SPAN)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None,
                 min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (best coverage of any notice) and the covered spans in words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_scan(notices or NOTICES, phrases or PHRASES, min_coverage), _SCHEMA)
