"""Licence scans with a generalised suffix automaton.

The automaton accepts every run of words of the licence templates.  Reading a
text through it gives, at each word, the longest run ending there that some
template holds (matching statistics); the shorter runs that other templates, or
other places of one, hold there are found along the suffix links.  Runs of at
least ``least`` words that cannot be extended are chained per template, in order
of both text and template, into covered spans; a template is found wherever a
chain covers enough of it.  Only stretches that hold a run of ``least`` template
words are read word by word; they are found with array operations over whole
batches.  A link of a chain is looked for among the matches within a template's
length and ``gap`` words before, so work follows the length of the text.

Plain phrases (two or three words) are counted too, wherever they stand.

Defined results: null text counts as empty; no phrase gives null positions and
empty labels; a template of fewer than ``least`` words is never found; where
notices of one label overlap, the one with more words covered stays, then the
earlier; repeated rows and null ids stay rows; ids may be of any type; an empty
table gives an empty one.  A text of any length is read whole, by one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces, split_words, text_array

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: licences' names, and what a short notice calls them.
NAMES = {
    "mit": ["mit license"],
    "apache": ["apache license version 2 0", "apache license 2 0"],
    "gpl": ["gnu general public license version 2", "gnu general public license version 3", "gnu gpl v2", "gnu gpl v3"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl": ["gnu affero general public license"],
    "bsd": ["bsd license", "2 clause bsd license", "3 clause bsd license"],
    "mpl": ["mozilla public license version 2 0", "mozilla public license v 2 0"],
    "epl": ["eclipse public license version 2 0"],
    "cc-by": ["creative commons attribution 4 0 international license", "cc by 4 0"],
    "cc-by-sa": ["creative commons attribution sharealike 4 0 international license", "cc by sa 4 0"],
    "cc-by-nc": ["creative commons attribution noncommercial 4 0 international license", "cc by nc 4 0"],
    "cc0": ["creative commons zero v1 0 universal license", "cc0 1 0"],
}

#: Public licences and the notices that they ask for, lower case, words only.
TEXTS = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
        liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
        in the software"""),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license"""),
    *[(label, f"""this program is free software you can redistribute it and or modify it under the terms of the {name} as published by
        the free software foundation either version {version} of the license or at your option any later version this program is distributed in the hope
        that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the {name} for more details you should have received a copy of the {name} along with this program if not see""")
        for label, name, versions in (("gpl", "gnu general public license", "2 3"), ("lgpl", "gnu lesser general public license", "2 3"), ("agpl", "gnu affero general public license", "3"))
        for version in versions.split()],
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or
        implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on
        any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this
        software even if advised of the possibility of such damage"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard
        to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct
        indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence
        or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications
        and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented
        you must not claim that you wrote the original software"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
        you can obtain one at"""),
]


def default_templates() -> list[tuple[str, str]]:
    """The texts, and a short notice of each name."""
    short = [(label, f"{how} under the {name}") for label, names in NAMES.items() for name in names for how in ("licensed", "released", "distributed")]
    return [*TEXTS, *short]


class SuffixAutomaton:
    """Of several sequences; each state knows all ends of its runs, as (sequence, end)."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state]:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state reached from ``state`` that holds no longer runs than those through it."""
        to = self.step[state][symbol]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._new(self.length[state] + 1, self.link[to], dict(self.step[to]))
        self.link[to] = copy
        while state >= 0 and self.step[state].get(symbol) == to:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.step[last]:
            return self._split(last, symbol)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and symbol not in self.step[state]:
            self.step[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol)
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """At each place: state and length of the longest accepted run that ends there."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.step[state]:
                state = self.step[state][symbol]
                length += 1
            else:
                state = length = 0
            yield state, length

    def shorter(self, state: int, length: int, least: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, end, words) of the longest run at each place of a sequence that ends where this one does."""
        seen: set[tuple[int, int]] = set()
        while state > 0 and length >= least:
            for number, end in self.ends[state] - seen:
                yield number, end, length
            seen |= self.ends[state]
            state = self.link[state]
            length = self.length[state]


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Chains of matches (text start, template start, words) without a common match, each with the template words it covers; the fullest first.

    Both starts ascend; what overlaps counts once, and text between two links of
    a chain is at most ``gap`` words.
    """
    matches = sorted(set(matches))
    reach = max((n for _, _, n in matches), default=0) + gap
    best: list[tuple[int, int]] = []
    first = 0
    for i, (t, p, n) in enumerate(matches):
        while matches[first][0] + reach < t:
            first += 1
        here = (n, -1)
        for j in range(first, i):
            t0, p0, n0 = matches[j]
            if t0 < t and p0 < p and t <= t0 + n0 + gap:
                new = n - max(0, p0 + n0 - p, t0 + n0 - t)
                if new > 0 and best[j][0] + new > here[0]:
                    here = (best[j][0] + new, j)
        best.append(here)
    out, used = [], [False] * len(matches)
    for i in sorted(range(len(best)), key=lambda k: (-best[k][0], k)):
        links, k = [], i
        while k >= 0 and not used[k]:
            used[k] = True
            links.append(matches[k])
            k = best[k][1]
        if links:
            links.reverse()
            done = covered = 0
            for _, p, n in links:
                covered += max(0, p + n - max(p, done))
                done = max(done, p + n)
            out.append((covered, links))
    return sorted(out, key=lambda x: (-x[0], x[1]))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], least: int, cover: float, gap: int) -> None:
        self.least, self.cover, self.gap = least, cover, gap
        self.labels = [label for label, _ in templates]
        texts = [text.split() for _, text in templates]
        vocabulary = sorted({w for t in texts for w in t} | {w for p in phrases for w in p.split()})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.sizes = [len(t) for t in texts]
        self.coded = coded = [[self.ids[w] for w in t] for t in texts]
        self.automaton = SuffixAutomaton(coded)
        self.vocabulary = pa.array(vocabulary)
        self.phrases = [([self.ids[w] for w in p.split()], label) for p, label in phrases.items()]
        grams = {tuple(c[i : i + least]) for c in coded for i in range(len(c) - least + 1)}
        self.grams = np.array(sorted(self._gram(g) for g in grams), np.uint64)

    def _gram(self, ids) -> np.uint64:  # noqa: ANN001
        key = 0
        for x in ids:
            key = key * (len(self.ids) + 1) + int(x)
        return np.uint64(key % (1 << 64))

    def codes(self, words: pa.Array) -> np.ndarray:
        """Vocabulary number of each word; one past the last for all others."""
        coded = words.dictionary_encode()
        of = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), len(self.ids)).to_numpy()
        return of[coded.indices.to_numpy()].astype(np.int64) if len(words) else np.zeros(0, np.int64)

    def stretches(self, codes: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By text: [start, end) of runs of known words that hold a template's run of ``least`` words."""
        n = len(codes) - self.least + 1
        if n <= 0 or not len(self.grams):
            return {}
        key = np.zeros(n, np.uint64)
        for i in range(self.least):
            key = key * np.uint64(len(self.ids) + 1) + codes[i : i + n].astype(np.uint64)
        found = self.grams[np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)] == key
        out: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(found).tolist():
            d = int(np.searchsorted(at, i, "right")) - 1
            lo, hi, ends = i, i, int(at[d + 1])
            if i + self.least > ends or (d in out and i < out[d][-1][1]):
                continue
            while lo > at[d] and codes[lo - 1] < len(self.ids):
                lo -= 1
            while hi < ends and codes[hi] < len(self.ids):
                hi += 1
            out.setdefault(d, []).append((lo, hi))
        return out

    def spans(self, codes: np.ndarray, stretches: list[tuple[int, int]], start: int) -> list[dict]:
        """Every notice found, and the best chain of a label without any: label, words covered from start to end, share of the template."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi in stretches:
            words = codes[lo:hi].tolist()
            after = [*words[1:], -1]
            for i, (state, n) in enumerate(self.automaton.statistics(words)):
                if n >= self.least:
                    for number, end, run in self.automaton.shorter(state, n, self.least):
                        if end == self.sizes[number] or self.coded[number][end] != after[i]:
                            by.setdefault(number, []).append((lo + i + 1 - run - start, end - run, run))
        found = []
        for number in sorted(by):
            for covered, links in chains(by[number], self.gap):
                found.append((-covered, links[0][0], {"label": self.labels[number], "start": links[0][0], "end": links[-1][0] + links[-1][2], "share": covered / self.sizes[number]}))
        out: list[dict] = []
        taken: dict[str, list[int]] = {}
        for _, _, x in sorted((x for x in found if x[2]["share"] >= self.cover), key=lambda x: x[:2]):
            ends = taken.setdefault(x["label"], [])
            i = bisect.bisect_right(ends, x["start"])
            # Starts and ends of what is taken, in order: a free place lies between an end and a start.
            if i % 2 == 0 and bisect.bisect_left(ends, x["end"]) in (i, i - 1):
                ends[i:i] = [x["start"], x["end"]]
                out.append(x)
        partial_: dict[str, dict] = {}
        for *_, x in found:
            if x["label"] not in taken and x["share"] > partial_.get(x["label"], {"share": 0.0})["share"]:
                partial_[x["label"]] = x
        return sorted([*out, *partial_.values()], key=lambda x: (x["start"], x["label"]))

    def places(self, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Label and starts of each phrase's places."""
        end = np.repeat(at[1:], np.diff(at))
        for ids, label in self.phrases:
            n = max(0, len(codes) - len(ids) + 1)
            hit = np.ones(n, bool)
            for i, x in enumerate(ids):
                hit &= codes[i : i + n] == x
            start = np.flatnonzero(hit)
            yield label, start[start + len(ids) <= end[start]]

    def scan(self, texts: pa.Array) -> dict[str, list]:
        words, at = split_words(_plain(texts))
        codes, rows = self.codes(words), len(texts)
        n_base, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        base: list[set[str]] = [set() for _ in range(rows)]
        for label, start in self.places(codes, at):
            doc = np.searchsorted(at, start, "right") - 1
            np.add.at(n_base, doc, 1)
            np.minimum.at(first, doc, start - at[doc])
            np.maximum.at(last, doc, start - at[doc])
            for d in np.unique(doc):
                base[d].add(label)
        spans: list[list[dict]] = [[] for _ in range(rows)]
        for d, found in self.stretches(codes, at).items():
            spans[d] = self.spans(codes, found, int(at[d]))
        full = [[s for s in x if s["share"] >= self.cover] for x in spans]
        return {
            "n_words": np.diff(at), "n_base": n_base,
            "first_word": [int(x) if n else None for x, n in zip(first, n_base, strict=True)], "last_word": [int(x) if n else None for x, n in zip(last, n_base, strict=True)],
            "base_labels": [",".join(sorted(x)) for x in base], "labels": [",".join(sorted(b | {s["label"] for s in f})) for b, f in zip(base, full, strict=True)],
            "score": [max([s["share"] for s in x], default=0.0) for x in spans], "spans": spans,
        }


#: Lower case for A-Z; a space for ASCII that is neither letter nor digit.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)], np.uint8)


def _plain(texts: pa.Array) -> pa.Array:
    _, offsets, data = texts.buffers()
    folded = _FOLD[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(folded.tobytes())], offset=texts.offset)


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>"


def _scan(batches: Iterator[pa.RecordBatch], *, templates: list, phrases: dict, least: int, cover: float, gap: int) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, phrases, least, cover, gap)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}
    for batch in pieces(batches, "_text"):
        found = scanner.scan(text_array(batch.column("_text")))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(found[k], t) for k, t in kinds.items()]], names=["_id", *kinds])


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, least: int = 4, cover: float = 0.8, gap: int = 8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best share of a template covered), spans (each notice, and of a label without one the best chain).  No shuffle."""
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    given = {"templates": templates or default_templates(), "phrases": phrases or PHRASES, "least": least, "cover": cover, "gap": gap}
    return plain.mapInArrow(partial(_scan, **given), f"_id {kind}, {_OUT}").withColumnRenamed("_id", id_col)
