"""Elias-Fano sequences and the n-gram trie that is made of them."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: Codes of quantised probabilities for each factor of ten.
CODES_PER_TEN = 4096
#: Values of a block; blocks that are read at once, at most; values that are packed at once; blocks
#: that nothing asks for between two that are read together.
BLOCK, SPAN, PACKED, GAP = 64, 2048, 1 << 17, 8
_ZERO = 65535


def quantised(values: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities: logarithms in equal steps, a code of its own for 0."""
    codes = np.full(len(values), _ZERO, np.uint16)
    some = values > 0
    codes[some] = np.clip(np.rint(-np.log10(values[some]) * CODES_PER_TEN), 0, _ZERO - 1).astype(np.uint16)
    return codes


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == _ZERO, 0.0, 10.0 ** (-codes.astype(np.float64) / CODES_PER_TEN))


class EliasFano:
    """A sequence that never falls, in about ``2 + log2(largest / count)`` bits for each value.

    The low bits of each value stand packed side by side in 64-bit words. The high bits are a bit
    vector: value ``i`` with high part ``h`` sets bit ``h + i``. Every ``BLOCK``-th value is kept as
    it is, with the place of its bit, so a search goes to one block and reads no other.
    """

    PARTS = ("lows", "highs", "samples", "places")

    def __init__(self, count: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray, places: np.ndarray):
        self.count, self.low, self.lows, self.highs, self.samples, self.places = count, low, lows, highs, samples, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low = max(0, (most // max(n, 1)).bit_length() - 1)
        lows = np.zeros((n * low + 63) // 64 + 1, np.uint64)
        highs = np.zeros(((most >> low) + n) // 8 + 1, np.uint8)
        places = np.empty(-(-n // BLOCK), np.int64)
        for at in range(0, n, PACKED):  # some values at a time
            part, index = values[at : at + PACKED], np.arange(at, min(at + PACKED, n))
            bit = (part >> np.uint64(low)).astype(np.int64) + index
            places[at // BLOCK : -(-(at + len(part)) // BLOCK)] = bit[::BLOCK]
            _set_bits(highs, bit)
            if low:
                _put(lows, index * low, part & np.uint64((1 << low) - 1), low)
        return cls(n, low, lows, highs, values[::BLOCK].copy(), places)

    def _span(self, lo: int, hi: int) -> np.ndarray:
        """The values of blocks ``lo`` to ``hi``."""
        first, last = lo * BLOCK, min(hi * BLOCK, self.count)
        start = int(self.places[lo]) // 8
        end = int(self.places[hi]) // 8 + 1 if hi < len(self.places) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[start:end], bitorder="little")) + start * 8
        ones = ones[np.searchsorted(ones, self.places[lo]) :][: last - first]
        index = np.arange(first, last)
        found = (ones - index).astype(np.uint64) << np.uint64(self.low)
        return found | _get(self.lows, index * self.low, self.low) if self.low else found

    def _blocks(self, wanted: np.ndarray):
        """(lo, hi, values) of stretches of blocks that hold all ``wanted`` (sorted) blocks, each of
        bounded size; blocks that nothing asks for are read only in small gaps."""
        if not len(wanted):
            return
        breaks = np.flatnonzero(np.diff(wanted) > GAP) + 1
        for part in np.split(wanted, breaks):
            for lo in range(int(part[0]), int(part[-1]) + 1, SPAN):
                hi = min(lo + SPAN, int(part[-1]) + 1)
                yield lo, hi, self._span(lo, hi)

    def values(self) -> np.ndarray:
        """The whole sequence as it was."""
        parts = [v for _, _, v in self._blocks(np.arange(len(self.samples)))]
        return np.concatenate([np.zeros(0, np.uint64), *parts])

    def at(self, index: np.ndarray) -> np.ndarray:
        """The values at some places."""
        found = np.empty(len(index), np.uint64)
        order = np.argsort(index, kind="stable")
        ordered = index[order]
        for lo, hi, own in self._blocks(np.unique(ordered // BLOCK)):
            a, b = np.searchsorted(ordered, [lo * BLOCK, hi * BLOCK])
            found[order[a:b]] = own[ordered[a:b] - lo * BLOCK]
        return found

    def successors(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is equal) of the first value that isn't below each wanted one."""
        wanted = np.asarray(wanted, np.uint64)
        found, equal = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        if not self.count or not len(wanted):
            return found, equal
        order = np.arange(len(wanted)) if (wanted[1:] >= wanted[:-1]).all() else np.argsort(wanted, kind="stable")
        ordered = wanted[order]
        # The block before the first sample that isn't below: its values, or that sample, are the answer.
        block = np.maximum(np.searchsorted(self.samples, ordered) - 1, 0)
        for lo, hi, own in self._blocks(np.unique(block)):
            a, b = np.searchsorted(block, [lo, hi])
            at = np.searchsorted(own, ordered[a:b])
            inside = at < len(own)
            found[order[a:b]] = at + lo * BLOCK
            equal[order[a:b]] = inside & (own[np.minimum(at, len(own) - 1)] == ordered[a:b])
            beyond = np.flatnonzero(~inside)
            if len(beyond) and hi < len(self.samples):
                equal[order[a:b][beyond]] = self.samples[hi] == ordered[a:b][beyond]
        return found, equal


def _starts(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(words, prepend=-1))


def _set_bits(target: np.ndarray, bits: np.ndarray) -> None:
    """Set bits at rising places."""
    word = bits >> 3
    starts = _starts(word)
    target[word[starts]] |= np.bitwise_or.reduceat((1 << (bits & 7)).astype(np.uint8), starts)


def _put(target: np.ndarray, bit: np.ndarray, values: np.ndarray, width: int) -> None:
    """Write values of ``width`` bits, one behind the other, from the given bits on."""
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    starts = _starts(word)
    target[word[starts]] |= np.bitwise_or.reduceat(values << shift, starts)
    over = np.flatnonzero((bit & 63) + width > 64)  # at most one value reaches over from a word
    target[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])


def _get(source: np.ndarray, bit: np.ndarray, width: int) -> np.ndarray:
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    found = source[word] >> shift
    over = np.flatnonzero((bit & 63) + width > 64)
    found[over] |= source[word[over] + 1] << (np.uint64(64) - shift[over])
    return found & np.uint64((1 << width) - 1)


class Trie:
    """Words that follow a word, and words that follow it after another one.

    Levels, each an Elias-Fano sequence over its parents' order:

    * ``words``: the middle words; pointers to their successors and to the words before them
    * ``successors`` of each word, with the discounted probability of the pair
    * ``before``: the words before each, with pointers to what follows both and the weight left over
    * ``thirds``: what follows both, not as a word but as its rank among the middle word's
      successors, so values stay small; with the discounted probability of the triple

    The parts are arrays over one memory-mapped file without a name.
    """

    def __init__(self, middle: np.ndarray, first: np.ndarray, last: np.ndarray, counts: np.ndarray, discount: float):
        """From different (middle, first, last), sorted in that order, with counts of 1 or more."""
        n = len(middle)
        new_word = _changes(middle)
        word = np.cumsum(new_word) - 1
        words = middle[new_word]
        new_before = new_word | _changes(first)
        before = np.cumsum(new_before) - 1
        # Pairs (middle, last) in order.
        order = np.lexsort((last, word))
        new_pair = _changes(word[order]) | _changes(last[order])
        pair = np.empty(n, np.int64)
        pair[order] = np.cumsum(new_pair) - 1
        pair_word, pair_last = word[order][new_pair], last[order][new_pair]
        pair_count = np.bincount(pair, weights=counts, minlength=len(pair_word))
        word_count = np.bincount(word, weights=counts, minlength=len(words))
        before_word, before_first = word[new_before], first[new_before]
        before_count = np.bincount(before, weights=counts, minlength=len(before_word))
        pair_start = np.searchsorted(pair_word, np.arange(len(words) + 1))
        rank = pair - pair_start[word]
        # The triples come by (middle, first, last), so ranks rise within each pair before them.
        self.spread = int(rank.max(initial=0)) + 1
        wide = np.uint64(32)
        levels = {
            "words": EliasFano.of(words),
            "to_successors": EliasFano.of(pair_start),
            "successors": EliasFano.of(pair_word.astype(np.uint64) << wide | pair_last.astype(np.uint64)),
            "before": EliasFano.of(before_word.astype(np.uint64) << wide | before_first.astype(np.uint64)),
            "thirds": EliasFano.of(before * self.spread + rank),
        }
        parts = {
            "pair": quantised(np.maximum(pair_count - discount, 0) / word_count[pair_word]),
            "word_rest": quantised(discount * np.bincount(pair_word, minlength=len(words)) / word_count),
            "triple": quantised(np.maximum(counts - discount, 0) / before_count[before]),
            "before_rest": quantised(discount * np.bincount(before, minlength=len(before_word)) / before_count),
        }
        self._map(levels, parts)

    def _map(self, levels: dict[str, EliasFano], parts: dict[str, np.ndarray]) -> None:
        arrays = {f"{k}.{p}": getattr(v, p) for k, v in levels.items() for p in EliasFano.PARTS} | parts
        with tempfile.TemporaryFile() as file:
            places, at = {}, 0
            for name, array in arrays.items():
                at += -at % 8
                places[name] = at
                file.seek(at)
                file.write(array.tobytes())
                at += array.nbytes
            file.truncate(max(at, 8))
            file.flush()
            self.memory = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        view = {n: np.frombuffer(self.memory, a.dtype, len(a), places[n]) for n, a in arrays.items()}
        self.levels = {k: EliasFano(v.count, v.low, *(view[f"{k}.{p}"] for p in EliasFano.PARTS)) for k, v in levels.items()}
        self.parts = {n: view[n] for n in parts}

    def query(self, middle: np.ndarray, first: np.ndarray, last: np.ndarray, apart: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) for each triple: its probability is ``a + b * p`` with ``p`` that of ``last`` alone;
        where ``apart`` holds, with ``p`` that of ``last`` behind ``middle``, which is counted elsewhere."""
        a, b = np.zeros(len(middle)), np.ones(len(middle))
        if not self.levels["words"].count:
            return a, b
        wide = np.uint64(32)
        word, known = self.levels["words"].successors(middle)
        word = np.where(known, word, 0)
        start = self.levels["to_successors"].at(word).astype(np.int64)
        pair, paired = self.levels["successors"].successors(word.astype(np.uint64) << wide | last.astype(np.uint64))
        paired &= known
        here, own = paired & ~np.asarray(apart), known & ~np.asarray(apart)
        a[here] = probability(self.parts["pair"][pair[here]])
        b[own] = probability(self.parts["word_rest"][word[own]])
        before, seen = self.levels["before"].successors(word.astype(np.uint64) << wide | first.astype(np.uint64))
        seen &= known
        rest = probability(self.parts["before_rest"][before[seen]])
        a[seen] *= rest
        b[seen] *= rest
        both = seen & paired
        at, found = self.levels["thirds"].successors((before[both] * self.spread + pair[both] - start[both]).astype(np.uint64))
        third = np.flatnonzero(both)[found]
        a[third] += probability(self.parts["triple"][at[found]])
        return a, b


def _changes(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new
