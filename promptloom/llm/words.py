"""Words of a batch of texts, hashed and encoded with numpy inside a task.

A batch of whole texts becomes flat arrays: the bytes of all words back to back, the offsets of
the words in them, and for each text the range of its words. No function here looks at a text in
pieces, and none drops a text: null counts as empty, an empty text has no words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that a task handles at once; a longer text makes a batch of its own.
BATCH_BYTES = 8 << 20
#: The same for tasks that hold many figures for each word.
HALF_BATCH_BYTES = 4 << 20
#: Bytes of words that are hashed at once (one word at least).
HASHED_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part the words ``[^\x20\x09-\x0D]+``.
WHITE = _WHITE

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Bytes that part the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
PUNCTUATION = _PLAIN

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_SEEDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, np.ndarray] = {}


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text in them); null gives an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES):
    """The same rows in batches of at most ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    _give_back()


def _give_back() -> None:
    """Return free memory to the system: the worker waits for its next task beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Words:
    """Words of a batch. ``data``: their bytes, ``offsets``: where each begins in ``data``,
    ``bounds``: text ``d`` has the words ``bounds[d]`` to ``bounds[d + 1]``. ``raw``: all bytes, the parting ones
    too, ``starts``: where each word begins in them."""

    def __init__(self, texts: pa.Array, apart: np.ndarray = WHITE, lower: bool = False):
        raw, ends = text_bytes(texts)
        if lower:
            raw = _LOWER[raw]
        kept = ~apart[raw]
        begins = kept.copy()
        begins[1:] &= ~kept[:-1]
        first = ends[:-1][ends[:-1] < len(raw)]  # a word never goes on from one text to the next
        begins[first] |= kept[first]
        starts = np.flatnonzero(begins)
        self.raw, self.starts = raw, starts
        self.data = raw[kept]
        parted = np.flatnonzero(~kept)  # kept bytes before a word: all before it but those that part words
        self.offsets = np.append(starts - np.searchsorted(parted, starts), len(self.data)).astype(np.int64)
        self.bounds = np.searchsorted(starts, ends)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def array(self) -> pa.Array:
        """The words as a binary array over the same bytes."""
        return pa.Array.from_buffers(
            pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)]
        )

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word: a polynomial of its bytes, mixed with its length."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = np.diff(self.offsets)
        powers, found = _powers(seed, int(lengths.max())), np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):  # some bytes at a time: each takes 40 bytes of working memory
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + HASHED_BYTES, "right")) - 1)
            data, offsets = self.data[self.offsets[at] : self.offsets[to]], self.offsets[at:to] - self.offsets[at]
            place = np.arange(len(data)) - np.repeat(offsets, lengths[at:to])
            values = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
            found[at:to] = np.add.reduceat(values, offsets)
            at = to
        return mix(found + lengths.astype(np.uint64))

    def joined(self, kept: np.ndarray) -> list[bytes]:
        """The kept words of each text joined by single spaces."""
        lengths = np.diff(self.offsets)
        data = self.data[np.repeat(kept, lengths)]
        sizes = lengths[kept]
        spaced = np.full(len(data) + len(sizes), 0x20, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
        ends = np.concatenate([[0], np.cumsum(np.where(kept, lengths + 1, 0))])[self.bounds]
        whole = spaced.tobytes()
        return [whole[lo : max(lo, hi - 1)] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _powers(seed: int, most: int) -> np.ndarray:
    table = _POWERS.get(seed)
    if table is None or len(table) < most:
        base = np.full(max(64, 2 * most), _SEEDS[seed] | 1, np.uint64)
        base[0] = 1
        table = _POWERS[seed] = np.multiply.accumulate(base)
    return table


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; one to one."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word, ends of texts not regarded."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(_ODD) + words[k : k + n]
    return mix(total + np.uint64(size))


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Indices of the words at which ``size`` words of one text begin."""
    room = np.maximum(np.diff(bounds) - size + 1, 0)
    return ragged(bounds[:-1], room)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` values for each i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(shift, counts) + np.repeat(np.asarray(starts, np.int64), counts)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of ``counts[i]`` values in row i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def pack(values: np.ndarray) -> bytes:
    """The bytes of an array, place by place of all its values, so that shuffles compress them."""
    raw = np.ascontiguousarray(values)
    return raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes()


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
