"""License scans with a generalised suffix automaton of license words.

The automaton holds every run of words of all templates. A text is streamed through it: after
each word the state gives the longest run of license words that ends there (its matching
statistic), and the state and its suffix links all places in templates that have this run or the end of it. Runs that the
next word does not continue are matches. Of the matches of one template those that lie close together and in order and
cover most of it are chained, and a chain that covers enough is a license span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import binary_texts, pieces

# Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as their licenses publish them, each with the label of its license.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights."),
    ("all-rights-reserved", "All rights reserved."),
)

# What follows on the first part of a notice in its license; the notice as a whole is a template too.
CONTINUED = {
    6: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
    "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    1: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see "
    "<https://www.gnu.org/licenses/>.",
    2: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more "
    "details. You should have received a copy of the GNU Lesser General Public License along with this library.",
    4: "See the License for the specific language governing permissions and limitations under the License.",
    7: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
    "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    8: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
}
assert [TEMPLATES[k][0] for k in CONTINUED] == ["mit", "gpl", "lgpl", "apache", "bsd", "isc"]
TEMPLATES += tuple((TEMPLATES[k][0], f"{TEMPLATES[k][1]} {rest}") for k, rest in CONTINUED.items())

LEAST_MATCH = 3  # words of a match that may be part of a chain
MOST_GAP = 6  # words between two matches of a chain
LEAST_COVERED = 0.6  # of a template, by a chain

_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_BLANK).split()


class LicenseAutomaton:
    """Suffix automaton of several word sequences.

    States have a length, a suffix link and edges by word; ``where`` gives the places (template, end) whose longest run
    in the automaton is the state's. The ends of that run, which its suffix links have, are at the same places.
    """

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.vocabulary: dict[bytes, int] = {}
        self.labels = [label for label, _ in templates]
        texts = [words(t.encode()) for _, t in templates]
        self.sizes = [len(t) for t in texts]
        named = [words(p.encode()) for p in phrases]
        self.phrase_labels = list(phrases.values())
        self.phrase_sizes = [len(p) for p in named]
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts + named:
            last = 0
            for w in text:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
        self.texts = [[self.vocabulary[w] for w in text] for text in texts]
        # After the last word is in: states that a later one has split off have their places too.
        self.where: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for number, text in enumerate(self.texts):
            self._mark(number, text)
        self.phrases = self._suffix_phrases([[self.vocabulary[w] for w in p] for p in named])

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.edges.append(edges)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.edges[last]:
            q = self.edges[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.edges[p]:
            self.edges[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.edges[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = copy
        while p >= 0 and self.edges[p].get(word) == q:
            self.edges[p][word] = copy
            p = self.link[p]
        return copy

    def _mark(self, number: int, text: list[int]) -> None:
        """Notes each place of a template in all states whose runs end there."""
        state = 0
        for end, word in enumerate(text, 1):
            state = up = self.edges[state][word]
            while up > 0:
                self.where[up].append((number, end))
                up = self.link[up]

    def places(self, state: int, length: int, least: int) -> dict[tuple[int, int], int]:
        """The template places where the last words of a run stand, ``least`` at least, each with how many do."""
        found: dict[tuple[int, int], int] = {}
        while state > 0 and length >= least:
            for place in self.where[state]:
                found.setdefault(place, length)
            state = self.link[state]
            length = self.length[state]
        return found

    def _suffix_phrases(self, named: list[list[int]]) -> list[list[int]]:
        """For each state the phrases that its longest run ends with."""
        own: dict[int, list[int]] = {}
        for number, phrase in enumerate(named):
            state = 0
            for w in phrase:
                state = self.edges[state][w]
            own.setdefault(state, []).append(number)
        found: list[list[int]] = [[] for _ in self.length]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            found[state] = own.get(state, []) + found[self.link[state]]
        return found

    def stream(self, ids: list[int]):
        """(position, state, length) of the longest license run that ends at each word, for words in a run."""
        state = length = 0
        for at, word in enumerate(ids):
            while state and word not in self.edges[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.edges[state]:
                state = self.edges[state][word]
                length += 1
            else:
                length = 0
            yield at, state, length


class Scanner:
    """Finds phrases and chained template spans in the words of a text."""

    def __init__(self, automaton: LicenseAutomaton, least_match: int, most_gap: int, least_covered: float):
        self.automaton = automaton
        self.least_match, self.most_gap, self.least_covered = least_match, most_gap, least_covered

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of two or more words that are all in the vocabulary of the licenses."""
        inside = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= 2
        return list(zip(starts[keep].tolist(), ends[keep].tolist()))

    def scan(self, ids: np.ndarray):
        """(phrase places [(start, phrase)], spans [(start, end, label, covered)])."""
        a = self.automaton
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int, int]] = []  # template, start, end, start in the template
        for start, end in self.runs(ids):
            own = ids[start:end].tolist()
            for at, state, length in a.stream(own):
                for phrase in a.phrases[state]:
                    if a.phrase_sizes[phrase] <= length:
                        places.append((start + at + 1 - a.phrase_sizes[phrase], phrase))
                if length < self.least_match:
                    continue
                following = own[at + 1] if at + 1 < len(own) else 0
                for (template, stop), n in a.places(state, length, self.least_match).items():
                    text = a.texts[template]
                    if stop == len(text) or text[stop] != following:
                        matches.append((template, start + at + 1 - n, start + at + 1, stop - n))
        return places, self._chains(matches)

    def _chains(self, matches):
        spans = []
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for template, *match in matches:
            by_template.setdefault(template, []).append(tuple(match))
        for template, mine in by_template.items():
            size = self.automaton.sizes[template]
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted(self._best(sorted(mine)), key=lambda c: (-c[0], c[1], c[2])):
                if covered / size < self.least_covered:
                    break
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    spans.append((start, end, self.automaton.labels[template], covered / size))
        return sorted(spans)

    def _best(self, mine: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """For each match (start, end, start in the template) the words that the best chain up to it covers, and its ends.

        A match follows on another that starts before it, here and in the template, and ends at most ``most_gap``
        words before it starts; words that both have count once.
        """
        best: list[tuple[int, int, int]] = []
        near = 0
        reach = np.maximum.accumulate([end for _, end, _ in mine]).tolist()
        for i, (start, end, there) in enumerate(mine):
            while reach[near] + self.most_gap < start:  # neither this match nor any before it comes near
                near += 1
            choice = (end - start, start, end)
            for j in range(near, i):
                s, e, t = mine[j]
                over = max(0, e - start, t + e - s - there)
                if s < start and t < there and e < end and start - e <= self.most_gap and over < end - start:
                    covered = best[j][0] + end - start - over
                    if covered > choice[0]:
                        choice = (covered, best[j][1], end)
            best.append(choice)
        return best


def _scan(automaton, least_match: int, most_gap: int, least_covered: float):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())])

    def run(source):
        machine = automaton.value
        scanner = Scanner(machine, least_match, most_gap, least_covered)
        look = machine.vocabulary.get
        for batch in pieces(source, 1):
            rows = []
            for text in binary_texts(batch.column(1)):
                own = words(text)
                ids = np.fromiter((look(w, 0) for w in own), np.int32, len(own))
                places, spans = scanner.scan(ids) if ids.any() else ([], [])
                starts = [p for p, _ in places]
                base = {machine.phrase_labels[k] for _, k in places}
                rows.append(
                    (
                        len(own),
                        len(places),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | {s[2] for s in spans})),
                        max((s[3] for s in spans), default=0.0),
                        [dict(zip(("start", "end", "label", "covered"), s)) for s in spans],
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=NAMES)

    return run


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases=PHRASES,
    least_match: int = LEAST_MATCH,
    most_gap: int = MOST_GAP,
    least_covered: float = LEAST_COVERED,
) -> DataFrame:
    """License phrases and notices in each row of ``docs(doc_id, text)``.

    Columns: doc_id, n_words, n_base (places of phrases), first_word and last_word (their smallest
    and largest start, words from 0), base_labels, labels (those of spans too), score (the largest
    part of a template that a chain covers, 0 without one) and spans(start, end, label, covered).
    Phrases are found wherever their words stand one after the other, also inside each other.

    Defined cases: null and blank texts have no words, no places, empty labels and score 0. Repeated rows
    are scanned each. Other columns are ignored. Labels are distinct, sorted by code point.

    Scale: one pass without a shuffle. The automaton has two states at most for each word of the
    templates and goes to every task; only stretches of two or more license words are streamed.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(LicenseAutomaton(templates, phrases))
    named = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    return named.mapInArrow(
        _scan(automaton, least_match, most_gap, least_covered),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<start:long,end:long,label:string,covered:double>>",
    )
