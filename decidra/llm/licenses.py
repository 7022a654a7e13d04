"""Licence detection with a positional index of rare licence words.

The postings of the licence templates (word, template, position) are held by every task; they are fixed. A first
pass over all texts counts in how many of them each licence word occurs. A second pass takes each text's licence words
with the highest inverse document frequency, looks up their postings, and intersects them by relative position: word
positions whose places minus template positions lie in one band support one alignment, so a word more or less between
them doesn't part it. An alignment is scored by the share of template words that stand within the band of their places, and a
label is given where the share is enough and a mandatory phrase of the template stands inside the alignment. Where the
rarest words support no whole alignment although such a phrase is there, the postings of all words near it are
intersected, which gives the share of every start.

Defined cases: null and empty texts have no words, no labels and score 0; rows with the same doc_id are separate rows.
An empty table gives no rows; a very long text is one row, its phrases are looked at in groups; of equal shares one counts, as the
score is the largest; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, bytes_of

# The phrases of the contract, the licences' own words and their mandatory phrases.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it
will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general
public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and
contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary
or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of
the use of this software even if advised of the possibility of such damage"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard
to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect
or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
tortious action arising out of or in connection with the use or performance of this software"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
_CC0 = """to the extent possible under law the author has waived all copyright and related or neighboring rights to this work this work is published from"""
_MPL = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
file you can obtain one at https mozilla org mpl 2 0"""
#: Whole notices and the sentences by which texts name a licence.
TEMPLATES = {
    "mit": ["released under the mit license", _MIT, _MIT.partition(" and to permit")[0]],
    "apache": ["licensed under the apache license version 2 0", _APACHE, _APACHE.partition(" unless")[0]],
    "gpl": ["this work is licensed under the gnu general public license version 3", _GPL, _GPL.partition(" this program is distributed")[0]],
    "bsd": [_BSD, _BSD.partition(" this software is provided")[0], _BSD.partition("\n")[0]],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0": [_CC0, _CC0.partition(" this work is published")[0]],
    "mpl": [_MPL, _MPL.partition(" if a copy")[0]],
    "isc": [_ISC, _ISC.partition(" provided")[0]],
    "unlicense": [_UNLICENSE, _UNLICENSE.partition(" anyone")[0]],
}
MANDATORY = {
    "mit": ["mit license", "permission is hereby granted free of charge"],
    "apache": ["apache license"],
    "gpl": ["general public license"],
    "bsd": ["redistribution and use in source and binary forms"],
    "cc-by-nc": ["cc by nc", "attribution noncommercial"],
    "cc-by": ["cc by 4", "attribution 4 0 international"],
    "cc0": ["waived all copyright"],
    "mpl": ["mozilla public license"],
    "isc": ["with or without fee"],
    "unlicense": ["released into the public domain"],
}

#: Licence words that are looked up for each alignment, the share of template words that must be in place, and the band:
#: words by which places may shift, for each this many words of the template.
RARE, SHARE, SHIFT = 6, 0.7, 8
#: Words of a text whose phrases are looked at together.
REACH = 1 << 16


class Index:
    """Postings of the templates' words, with word numbers in place of words."""

    def __init__(self) -> None:
        self.templates = [(label, t.encode().split()) for label, texts in TEMPLATES.items() for t in texts]
        self.number = {w: i for i, w in enumerate(sorted({w for _, t in self.templates for w in t}))}
        self.coded = [np.array([self.number[w] for w in t]) for _, t in self.templates]
        self.at = [{w: np.flatnonzero(t == w) for w in dict.fromkeys(t.tolist())} for t in self.coded]
        self.postings = defaultdict(list)
        for k, t in enumerate(self.coded):
            for place, w in enumerate(t.tolist()):
                self.postings[w].append((k, place))
        coded = lambda phrase: [self.number[w] for w in phrase.encode().split()]
        self.base = [(label, coded(p)) for label, p in PHRASES.items()]
        self.mandatory = {label: [coded(p) for p in texts] for label, texts in MANDATORY.items()}

    def codes(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))


INDEX = Index()


def places(codes: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Starts at which the words of phrase stand consecutively."""
    if len(codes) < len(phrase):
        return np.empty(0, np.int64)
    starts = np.flatnonzero(codes[: len(codes) - len(phrase) + 1] == phrase[0])
    for k, w in enumerate(phrase[1:], 1):
        starts = starts[codes[starts + k] == w]
    return starts


def voted(known: np.ndarray, codes: np.ndarray, template: int, words: list[int], least: int, band: int) -> np.ndarray:
    """Starts at which at least this many of the words support an alignment: one for each band of them."""
    offsets = [(known[codes[known] == w] - p, w) for w in words for k, p in INDEX.postings[w] if k == template]
    starts = np.concatenate([x for x, _ in offsets]) if offsets else np.empty(0, np.int64)
    who = np.concatenate([np.full(len(x), w) for x, w in offsets]) if offsets else starts
    out = []
    for shift in (0, band):  # two grids of bands, so that no alignment is cut by a border
        cell = (starts + shift) // (2 * band + 1)
        pairs = np.unique(np.stack([cell, who]), axis=1)
        cells, votes = np.unique(pairs[0], return_counts=True)
        for c in cells[votes >= least].tolist():
            inside = np.sort(starts[cell == c])
            out.append(int(inside[len(inside) // 2]))
    return np.unique(np.array(out, np.int64))


def shares(codes: np.ndarray, template: np.ndarray, start: int, band: int) -> np.ndarray:
    """For each start within band of this one the share of the template's words that stand within band words of their places."""
    at = start + np.arange(len(template)) + np.arange(-2 * band, 2 * band + 1)[:, None]
    same = (codes[np.clip(at, 0, len(codes) - 1)] == template) & (at >= 0) & (at < len(codes))
    upto = np.concatenate((np.zeros((1, len(template)), np.int64), np.cumsum(same, axis=0)))
    return (upto[2 * band + 1 :] > upto[: 2 * band + 1]).mean(axis=1)


def covered(known: np.ndarray, codes: np.ndarray, k: int, phrases: np.ndarray, band: int) -> float:
    """The largest share of template k over all starts whose alignment holds a phrase.

    Each posting of the template supports the starts within band of its relative position; those of one place in the template
    count once. Sums over where support begins and ends give every start's share. Words out of reach of a phrase don't
    matter, so phrases go in groups by where they stand.
    """
    n, best = len(INDEX.coded[k]), 0
    reach = n + 2 * band
    for group in np.split(phrases, np.flatnonzero(np.diff(phrases // REACH)) + 1):
        near = known[np.searchsorted(known, group[0] - reach) : np.searchsorted(known, group[-1] + reach + 1)]
        near = near[np.searchsorted(group, near - reach) < np.searchsorted(group, near + reach + 1)]
        pairs = [np.stack(np.broadcast_arrays((near[codes[near] == w][:, None] - at), at)).reshape(2, -1) for w, at in INDEX.at[k].items()]
        start, place = np.concatenate(pairs, axis=1)
        order = np.lexsort((start, place))
        start, place = start[order], place[order]
        low, high = start - band, start + band + 1
        again = np.flatnonzero(place[1:] == place[:-1]) + 1
        low[again] = np.maximum(low[again], high[again - 1])
        at, count = np.concatenate((low, high)), np.repeat((1, -1), len(low))
        order = np.argsort(at, kind="stable")
        at, count = at[order], np.cumsum(count[order])
        last = np.flatnonzero(np.append(at[1:] != at[:-1], False))
        holds = np.searchsorted(group, at[last] - band) < np.searchsorted(group, at[last + 1] + n + band - 1)
        best = max(best, int(np.where(holds, count[last], 0).max(initial=0)))
    return best / n


def aligned(codes: np.ndarray, idf: np.ndarray) -> dict[str, float]:
    """Label -> share of template words in place, for the best alignment that a phrase inside verifies.

    An alignment that rare words support and that is whole can't be beaten; else the postings of all words near a phrase decide.
    """
    known = np.flatnonzero(codes >= 0)
    if not len(known):
        return {}
    wanted = set(np.unique(codes[known]).tolist())
    best: dict[str, float] = {}
    phrases: dict[str, np.ndarray] = {}
    for k, template in enumerate(INDEX.coded):
        label, n = INDEX.templates[k][0], len(template)
        present = [w for w in INDEX.at[k] if w in wanted]
        if sum(len(INDEX.at[k][w]) for w in present) < SHARE * n:  # as many places can be filled at most
            continue
        if label not in phrases:
            phrases[label] = np.unique(np.concatenate([places(codes, p) for p in INDEX.mandatory[label]]))
        if not len(phrases[label]) or best.get(label, 0) == 1:
            continue
        band, share = n // SHIFT, 0.0
        rare = sorted(present, key=lambda w: (-idf[w], w))[:RARE]
        for start in voted(known, codes, k, rare, max(2, len(rare) // 2), band).tolist():
            near = start + np.arange(-band, band + 1)
            inside = np.searchsorted(phrases[label], near + n + band) > np.searchsorted(phrases[label], near - band)
            share = max(share, float(np.where(inside, shares(codes, template, start, band), 0.0).max()))
        if share < 1:
            share = max(share, covered(known, codes, k, phrases[label], band))
        if share >= SHARE:
            best[label] = max(share, best.get(label, 0))
    return best


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(len(INDEX.number), np.int64), 0
    for batch in batches:
        for text in bytes_of(batch.column(0)):
            codes = INDEX.codes(alnum_words(text))
            seen[np.unique(codes[codes >= 0])] += 1
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(seen))), pa.array(np.concatenate(([n], seen)))], names=["word", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln(N / n) of each licence word over all texts; the words are as many as the templates have."""
    rows = docs.select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = max(1, counts.get(-1, 0))
    return np.array([math.log((total + 1) / (counts.get(w, 0) + 1)) for w in range(len(INDEX.number))])


_SCANNED = "_rid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels and score of every row of docs (_rid, doc_id, text)."""
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs))

    def one(text: bytes) -> tuple:
        codes = INDEX.codes(alnum_words(text))
        starts = {label: places(codes, p) for label, p in INDEX.base}
        every = np.concatenate(list(starts.values()))
        base = {label for label, x in starts.items() if len(x)}
        scores = aligned(codes, idf.value)
        first, last = (int(every.min()), int(every.max())) if len(every) else (None, None)
        return len(codes), len(every), first, last, sorted(base), sorted(base | set(scores)), max([0.5 * bool(base), *scores.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
        for batch in batches:
            columns = list(zip(*map(one, bytes_of(batch.column(2))), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in _SCANNED.split(", ")])

    return docs.select("_rid", "doc_id", "text").mapInArrow(run, _SCANNED)
