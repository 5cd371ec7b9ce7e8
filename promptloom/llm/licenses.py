"""License scan: shared runs of words pick candidate templates, banded alignment measures them.

Templates are few and of fixed size, so their inverted index goes to every task, and the scan needs
no shuffle. Fingerprints are runs of ``GRAM`` words, of which a template and the texts keep the smallest
of each stretch; how long a stretch may be follows from the coverage that is asked for, so that
every match has a fingerprint (``stretch_for``). A local alignment that scores 2 or more has two equal
words in a row, as any other or missing word takes back what a single one gave; of those that score
1 the first end, a single word, is taken. So where a fifth of the words may be changed at any
place the stretch is 1. A candidate whose surroundings hold too
few words of the template is left; for the others a Smith-Waterman alignment in a band around the
diagonal reports how much of the template stands in the text, and where.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptloom.llm.words import PUNCTUATION, Words, ragged, sequence_hashes, slices

GRAM = 2
#: Fingerprints of a stretch of which ``winnowed`` keeps the smallest.
SPREAD = 3
#: Diagonals on either side of a candidate's that the alignment may use.
BAND = 8
#: Share of the template's words that must be matched.
LEAST_COVERAGE = 0.8

# Fixed values: (license, template) texts, as licenses ask to be cited or stated.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
        "ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


class Match(NamedTuple):
    """Words ``start`` to ``end`` of a text hold ``matched`` of the template's words."""

    license: str
    template: int
    matched: int
    coverage: float
    start: int
    end: int


def winnowed(hashes: np.ndarray, text: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Flags of the hashes that are the smallest of a stretch of ``spread`` in their text."""
    n, most = len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF)
    least = hashes.copy()
    for k in range(1, min(spread, n)):
        later = np.where(text[k:] == text[:-k], hashes[k:], most)
        least[:-k] = np.minimum(least[:-k], later)
    kept = least == hashes
    for k in range(1, min(spread, n)):
        kept[k:] |= (least[:-k] == hashes[k:]) & (text[k:] == text[:-k])
    return kept


def _grams(words: Words, size: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, text) of the runs of ``size`` words that lie in one text."""
    hashes = sequence_hashes(words.hashes(), size)
    text = words.text_of()
    at = np.flatnonzero(text[: len(hashes)] == text[size - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[at], at, text[at]


def stretch_for(size: int, least: float) -> int:
    """Of how many neighbouring fingerprints one is enough for a template of ``size`` words.

    A match leaves out at most ``u`` of the template's words, and in a band of ``BAND`` diagonals at most
    ``2 * BAND + u`` words stand between its others: so its words stand in ``2 * (u + BAND) + 1`` runs
    at most, and one of them is at least as long as that share of them. Where half of the words or
    more may be changed at any place this gives 1, all fingerprints.
    """
    matched = math.ceil(least * size)
    run = -(-matched // (2 * (size - matched + BAND) + 1))
    return max(1, run - GRAM + 1)


class Index:
    """Inverted index of the fingerprints of all templates: all runs of ``GRAM`` words of those that a
    match may share no longer run with, the winnowed ones of others, by their stretch."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST_COVERAGE):
        self.licenses = [name for name, _ in templates]
        words = Words(pa.array([t for _, t in templates], pa.large_string()), PUNCTUATION, lower=True)
        own = words.hashes()
        self.words = [own[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:])]
        spread = np.array([stretch_for(int(n), least) for n in words.counts], np.int64)
        hashes, at, text = _grams(words)
        single, first, alone = _grams(words, 1)
        self.lone = bool((words.counts == 1).any())
        #: For each stretch: (hashes, sorted; template; place in it).
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for stretch in np.unique(spread).tolist():
            kept = spread[text] == stretch
            h, w, t = hashes[kept], at[kept], text[kept]
            if stretch > 1:
                some = winnowed(h, t, stretch)
                h, w, t = h[some], w[some], t[some]
            else:
                lone = words.counts[alone] == 1
                h, w, t = (np.concatenate([x, y[lone]]) for x, y in ((h, single), (w, first), (t, alone)))
            order = np.argsort(h, kind="stable")
            self.keys[stretch] = h[order], t[order], (w - words.bounds[t])[order]

    def candidates(self, words: Words) -> np.ndarray:
        """Rows (text, template, diagonal, word of the text) that shared fingerprints propose, each once."""
        rows = set()
        grams = _grams(words)
        alone = _grams(words, 1) if self.lone else None
        for stretch, (keys, template, place) in self.keys.items():
            hashes, at, text = grams
            if stretch > 1:
                some = winnowed(hashes, text, stretch)
                hashes, at, text = hashes[some], at[some], text[some]
            elif alone is not None:
                hashes, at, text = (np.concatenate(parts) for parts in zip(grams, alone))
            if not len(keys):
                continue
            among = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            own = keys[among] == hashes
            hashes, at, text = hashes[own], at[own], text[own]
            lo, hi = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
            many = hi - lo
            which = ragged(lo, many)
            t, w = np.repeat(text, many), np.repeat(at, many)
            inside = w - words.bounds[t]
            rows.update(zip(t.tolist(), template[which].tolist(), (inside - place[which]).tolist(), inside.tolist()))
        return sorted(rows)


def aligned(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int, int]:
    """Best local alignment within ``band`` of a diagonal: (score, matched words, start, end).

    An equal word counts 1, another or a missing word -1; a start that comes to 0 stays. Of equal scores the first end is taken.
    """
    first, width = diagonal - band, 2 * band + 1
    before = [(0, 0, 0)] * (width + 1)  # score, matched, start, for each place of the band
    best = (0, 0, 0, 0)
    own, words = template.tolist(), text
    for i, word in enumerate(own):
        row: list[tuple[int, int, int]] = []
        left = (0, 0, 0)
        for k in range(width):
            j = first + i + k  # word of the text
            if j < 0 or j >= len(words):
                cell = (0, 0, 0)
            else:
                score, matched, start = before[k]  # (i - 1, j - 1)
                if words[j] == word:
                    cell = (score + 1, matched + 1, start if matched else j)
                else:
                    cell = (score - 1, matched, start)
                up = before[k + 1] if k + 1 < width else (0, 0, 0)  # (i - 1, j)
                for other in (up, left):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, other[1], other[2])
                if cell[0] < 0:
                    cell = (0, 0, 0)
                elif cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
            row.append(cell)
            left = cell
        before = [*row, (0, 0, 0)]
    return best


def _occurrences(index: Index, own: list[int], template: int, diagonal: int, least: float) -> Iterator[Match]:
    """All matches in the band of a diagonal: the best one, then those before and behind it."""
    goal = index.words[template]
    known = goal.tolist()
    todo = [(max(0, diagonal - BAND), min(len(own), diagonal + len(goal) + 2 * BAND))]
    while todo:
        lo, hi = todo.pop()
        whole = next((j for j in range(lo, hi - len(known) + 1) if own[j : j + len(known)] == known), None)
        if whole is not None:  # no alignment is better than all words in order
            yield Match(index.licenses[template], template, len(known), 1.0, whole, whole + len(known))
            todo += [(lo, whole), (whole + len(known), hi)]
            continue
        here = set(own[lo:hi])
        if sum(word in here for word in known) < least * len(goal):  # too few of its words for a match
            continue
        _, matched, start, end = aligned(own[lo:hi], goal, diagonal - lo + BAND // 2)
        if matched and matched >= least * len(goal):
            yield Match(index.licenses[template], template, matched, matched / len(goal), start + lo, end + lo)
            todo += [(lo, start + lo), (end + lo, hi)]


def find(index: Index, texts: pa.Array, least: float = LEAST_COVERAGE) -> list[list[Match]]:
    """Matches of each text by start. Of matches that overlap in the text the one with more matched
    words stays (of equal ones the better covered, then the first template)."""
    words = Words(texts, PUNCTUATION, lower=True)
    found: list[list[Match]] = [[] for _ in range(len(texts))]
    if not len(words):
        return found
    hashes = words.hashes()
    for (text, template), rows in groupby(index.candidates(words), key=lambda c: c[:2]):
        own = hashes[words.bounds[text] : words.bounds[text + 1]].tolist()
        seen = bytearray(len(own))  # words that lie in what is found already
        for diagonal, places in groupby(rows, key=lambda c: c[2]):
            if all(seen[c[3]] for c in places):
                continue
            for m in _occurrences(index, own, template, diagonal, least):
                found[text].append(m)
                seen[m.start : m.end] = b"\1" * (m.end - m.start)
    for k, own in enumerate(found):
        kept: list[Match] = []
        taken = bytearray(max((m.end for m in own), default=0))
        for m in sorted(set(own), key=lambda m: (-m.matched, -m.coverage, m.template, m.start)):
            if taken.find(1, m.start, m.end) < 0:
                kept.append(m)
                taken[m.start : m.end] = b"\1" * (m.end - m.start)
        found[k] = sorted(kept, key=lambda m: m.start)
    return found


def report(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, n_matches, licenses (different names, sorted, comma-joined), coverage (of the best
    match, 0 without one), matches (array of structs license, coverage, matched, start, end, in
    words) of every row.

    Null and empty texts hold nothing; repeated rows give repeated results; other columns aren't
    read. The templates are a parameter; their index is broadcast.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, least))
    kind = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find(index.value, batch["text"], least)
            rows = [
                [{"license": m.license, "coverage": m.coverage, "matched": m.matched, "start": m.start, "end": m.end} for m in f]
                for f in found
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({m.license for m in f})) for f in found], pa.string()),
                    pa.array([max([0.0, *(m.coverage for m in f)]) for f in found], pa.float64()),
                    pa.array(rows, pa.list_(kind)),
                ],
                ["doc_id", "n_matches", "licenses", "coverage", "matches"],
            )

    schema = (
        "doc_id long, n_matches long, licenses string, coverage double, "
        "matches array<struct<license: string, coverage: double, matched: bigint, start: bigint, end: bigint>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)
