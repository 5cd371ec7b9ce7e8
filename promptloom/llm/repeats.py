"""Substring dedup by recompression.

Rounds of recompression parse every text into symbols: a run of two equal symbols or a pair whose
names fall on the left and on the right side gets one name, a hash of what it stands for, so names
are global without a table of names. Whether two symbols are joined depends on them and their
neighbours only. Equal stretches of words therefore have equal symbols but for a few words at
either edge. The rounds here join up to ``LONGEST`` words: then of any 13 equal words the borders of
symbols between word ``EDGE`` and word ``13 - EDGE`` are the same wherever the words stand, and there is
at least one, as no symbol is longer than that stretch.

Each window names the smallest border context (10 words around a border, inside the window) in that
stretch. Windows that are equal name the same one, so

1. one shuffle of the contexts shows which are shared by documents: few in original text;
2. one shuffle of the windows that name a shared context verifies them, and shows which of them
   begin in a document with a smaller id;
3. words that such windows cover are removed where the text is read.

Runs longer than two symbols are left as they are: their length can depend on words outside.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptloom.llm import keys
from promptloom.llm.words import WHITE, Words, mix, sequence_hashes, window_starts
from promptloom.session import discard, stored

#: Words of a window, words that a symbol stands for at most, words at an edge whose symbols differ.
WINDOW, LONGEST, EDGE = 13, 4, 5
#: Words on either side of a border that name it.
SIDE = 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _merged(names, sizes, text, first, salt):
    """Join each flagged symbol with the next one and name the result."""
    joined = names.copy()
    at = np.flatnonzero(first)
    joined[at] = mix(names[at] * np.uint64(0x9E3779B97F4A7C15) + mix(names[at + 1] + np.uint64(salt)))
    sizes = sizes.copy()
    sizes[at] += sizes[at + 1]
    kept = np.ones(len(names), bool)
    kept[at + 1] = False
    return joined[kept], sizes[kept], text[kept]


def name_runs(names, sizes, text, salt):
    """Runs of exactly two equal single words become one symbol."""
    if len(names) < 2:
        return names, sizes, text
    same = np.concatenate([[False], (names[1:] == names[:-1]) & (text[1:] == text[:-1]), [False]])
    first = np.zeros(len(names), bool)
    first[:-1] = same[1:-1] & ~same[:-2] & ~same[2:] & (sizes[:-1] == 1)
    return _merged(names, sizes, text, first, salt)


def name_pairs(names, sizes, text, salt, longest):
    """A left symbol and a right one after it become one symbol, if it isn't too long. A bit of a
    symbol's name says on which side it is."""
    if len(names) < 2:
        return names, sizes, text
    right = mix(names ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1) == 1
    first = np.zeros(len(names), bool)
    first[:-1] = ~right[:-1] & right[1:] & (text[1:] == text[:-1]) & (sizes[1:] + sizes[:-1] <= longest)
    return _merged(names, sizes, text, first, salt)


def borders(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Flags of the words at which a symbol begins after all rounds."""
    symbols = (hashes, np.ones(len(hashes), np.int64), text)
    symbols = name_runs(*symbols, 1)
    symbols = name_pairs(*symbols, 2, 2)
    symbols = name_pairs(*symbols, 3, LONGEST)
    flags = np.zeros(len(hashes), bool)
    if len(hashes):
        flags[np.cumsum(symbols[1]) - symbols[1]] = True
    return flags


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name of the smallest border context) of every window of every text."""
    starts = window_starts(words.bounds, WINDOW)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    hashes = words.hashes()
    around = sequence_hashes(hashes, 2 * SIDE)  # at b - SIDE: the words around border b
    around = np.where(borders(hashes, words.text_of())[SIDE : SIDE + len(around)], around, _NONE)
    least = around[starts]  # border EDGE of the window
    for k in range(1, WINDOW - 2 * EDGE + 1):
        least = np.minimum(least, around[starts + k])
    return starts, least


def _window_keys(words: Words, starts: np.ndarray) -> np.ndarray:
    return sequence_hashes(words.hashes(1), WINDOW)[starts]


def _rows_of(words: Words, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.bounds, starts, "right") - 1


def _anchor_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = Words(batch["text"], WHITE)
    starts, names = anchors(words)
    rows = _rows_of(words, starts)
    new = np.ones(len(names), bool)  # windows side by side mostly name the same context
    new[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
    return names[new], rows[new]


def _flagged(words: Words, names: np.ndarray, starts: np.ndarray, ids: pa.Array, found: keys.Found) -> np.ndarray:
    """Flags of the windows whose name was found for the document of their text."""
    flags = np.zeros(len(names), bool)
    bounds = np.searchsorted(starts, words.bounds)
    for row, owner in enumerate(ids.to_pylist()):
        wanted = found.of(owner)
        if len(wanted):
            lo, hi = bounds[row], bounds[row + 1]
            flags[lo:hi] = np.isin(names[lo:hi], wanted)
    return flags


def remove_repeats(docs: DataFrame, with_text: bool = False, group_bytes: int = keys.GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every row of ``docs``.

    A word is removed if a window of 13 words over it, its words in the same order, also begins in a
    document with a smaller doc_id. Null and empty texts have no words. Rows with the same doc_id
    are judged each by itself against smaller ids. Rows with a null doc_id keep all their words and
    take none from others. Other columns aren't read; an empty table gives an empty one.
    """
    texts = docs.select("doc_id", "text")
    total = keys.text_bytes_of(texts)
    shards, salts = keys.shards_of(docs, total), keys.salts_for(texts, group_bytes, total)

    def candidates(batch: pa.RecordBatch, found: keys.Found) -> pa.RecordBatch | None:
        def keys_of(own: pa.RecordBatch):
            words = Words(own["text"], WHITE)
            starts, names = anchors(words)
            starts = starts[_flagged(words, names, starts, own["doc_id"], found)]
            return _window_keys(words, starts), _rows_of(words, starts)

        return keys.pack_pairs(batch, "doc_id", keys_of, shards)

    shared = stored(keys.held(keys.pairs(texts, "doc_id", _anchor_keys, shards=shards), later=False))
    later = stored(keys.held(keys.meet(texts, "doc_id", shared, candidates, keys.SCHEMA, salts), later=True))
    discard(shared)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def cleaned(batch: pa.RecordBatch, found: keys.Found) -> pa.RecordBatch:
        words = Words(batch["text"], WHITE)
        kept = np.ones(len(words), bool)
        if len(found.keys):
            starts = window_starts(words.bounds, WINDOW)
            at = starts[_flagged(words, _window_keys(words, starts), starts, batch["doc_id"], found)]
            change = np.zeros(len(words) + 1, np.int64)
            change[at] += 1
            change[at + WINDOW] -= 1
            kept = np.cumsum(change)[:-1] <= 0
        removed = np.concatenate([[0], np.cumsum(~kept)])[words.bounds]
        joined = words.joined(kept)
        columns = [
            batch["doc_id"],
            pa.array(words.counts, pa.int64()),
            pa.array(np.diff(removed), pa.int64()),
            pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array([j.decode("utf-8") for j in joined], pa.string()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(columns, names)

    return keys.meet(texts, "doc_id", later, cleaned, schema, salts)
