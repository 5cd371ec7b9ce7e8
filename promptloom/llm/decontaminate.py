"""Benchmark decontamination by suffix arrays of the training text.

Each task takes a shard of the training documents (a batch of whole texts), numbers their words by
the benchmark's vocabulary and builds a suffix array over every stretch that can hold a window. All
test suffixes are then binary-searched in it together: the range a suffix finds are its verbatim
occurrences. Words that no item has can't be part of a match, so they end a stretch; that leaves
out nothing.

The benchmark is the query set. Its text is measured first; blocks of at most ``BLOCK_BYTES`` on
average go to the tasks one after another, each in a pass of its own over the rows. A benchmark of
one block needs no shuffle: a document's result is made where the document is read. A batch is
searched only for windows whose runs of three words it may hold, so that a pass costs what the
batch shares with the block, not what the block holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from promptloom.llm.words import PUNCTUATION, Words, list_array, ragged, sequence_hashes, slices
from promptloom.session import stored

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Benchmark text that is searched in one pass.
BLOCK_BYTES = 16 << 20
#: Words of the runs by which windows are told that can't be in a batch, and bits of their codes.
GRAM, FLAG_BITS = 3, 24


class TestSuffixes:
    """Words of a block of items as numbers, and its different windows with the items they are in."""

    def __init__(self, item_ids: list[int], texts: list[str], window: int):
        words = Words(pa.array(texts, pa.large_string()), PUNCTUATION, lower=True)
        spelled = words.array().dictionary_encode()
        self.vocabulary = spelled.dictionary
        self.sequence = spelled.indices.to_numpy().astype(np.int64) + 1
        self.depth = window
        different: dict[bytes, int] = {}
        starts, sizes, owners, places = [], [], [], []
        for item, (lo, hi) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
            size = min(window, hi - lo)
            for at in range(lo, hi - size + 1 if size else lo):
                key = self.sequence[at : at + size].tobytes()
                number = different.setdefault(key, len(different))
                if number == len(starts):
                    starts.append(at)
                    sizes.append(size)
                    owners.append([])
                    places.append([])
                owners[number].append(item)
                places[number].append(at - lo)
        self.starts, self.sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        self.items = np.array(item_ids, np.int64)
        self.per_window = np.array([len(o) for o in owners], np.int64)
        self.first_owner = np.cumsum(self.per_window) - self.per_window
        self.owner = np.array([i for o in owners for i in o], np.int64)
        self.place = np.array([p for o in places for p in o], np.int64)
        self.grams = _gram_codes(self.sequence)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word of the batch, window) for every occurrence of every window."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.starts) or not len(words):
            return nothing
        known = pa.compute.index_in(words.array(), self.vocabulary).fill_null(-1)
        numbers = known.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        inside = numbers > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        text_starts = words.bounds[:-1][words.counts > 0]
        begins[text_starts] = inside[text_starts]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        stops[(words.bounds[1:] - 1)[words.counts > 0]] |= inside[(words.bounds[1:] - 1)[words.counts > 0]]
        lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        long_enough = hi - lo >= self.sizes.min()
        lo, hi = lo[long_enough], hi[long_enough]
        if not len(lo):
            return nothing
        stretch = ragged(lo, hi - lo + 1)  # one place more, for the end of the stretch
        ends = np.cumsum(hi - lo + 1) - 1
        text = numbers[np.minimum(stretch, len(numbers) - 1)]
        text[ends] = 0
        suffixes = suffix_array(text, self.depth)
        asked = self.possible(text)
        first, last = self.find(text, suffixes, asked)
        counts = last - first
        return stretch[suffixes[ragged(first, counts)]], np.repeat(asked, counts)

    def possible(self, text: np.ndarray) -> np.ndarray:
        """The windows whose runs of ``GRAM`` words may all be in the text. Runs are looked up in a
        table of flags, so this costs little for each window, and only the others are searched."""
        flags = np.zeros(1 << FLAG_BITS, bool)
        flags[_gram_codes(text)] = True
        missing = np.zeros(len(self.sequence) + 1, np.int64)
        missing[1 : len(self.grams) + 1] = ~flags[self.grams]
        missing[len(self.grams) + 1 :] = 0
        before = np.cumsum(missing)
        runs = np.maximum(self.sizes - GRAM + 1, 0)  # none in a shorter window, which is always asked
        return np.flatnonzero(before[self.starts + runs] == before[self.starts])

    def find(self, text: np.ndarray, suffixes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of some windows: the range of suffixes that begin with each of them."""
        bounds, starts, sizes = [], self.starts[asked], self.sizes[asked]
        for beyond_equal in (False, True):
            lo = np.zeros(len(starts), np.int64)
            hi = np.full(len(starts), len(suffixes), np.int64)
            while (open_ := lo < hi).any():
                middle = (lo + hi) // 2
                at = suffixes[np.minimum(middle, len(suffixes) - 1)]
                order = np.zeros(len(lo), np.int8)
                for k in range(self.depth):
                    live = (order == 0) & (k < sizes)
                    theirs = text[np.minimum(at + k, len(text) - 1)]
                    ours = self.sequence[np.minimum(starts + k, len(self.sequence) - 1)]
                    order = np.where(live, np.sign(theirs - ours), order)
                right = open_ & ((order < 0) | (beyond_equal & (order == 0)))
                lo = np.where(right, middle + 1, lo)
                hi = np.where(open_ & ~right, middle, hi)
            bounds.append(lo)
        return bounds[0], bounds[1]


def _gram_codes(numbers: np.ndarray) -> np.ndarray:
    """A code of ``FLAG_BITS`` bits for each run of ``GRAM`` words."""
    return (sequence_hashes(numbers.astype(np.uint64), GRAM) >> np.uint64(64 - FLAG_BITS)).astype(np.int64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` words or more, by doubling; 0 ends a stretch."""
    rank, k = text, 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(len(text), np.int64)
        after[:-k] = rank[k:]
        after[rank == 0] = 0
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[False], np.diff(key[order]) != 0])
        ranked = np.cumsum(step) + (key[order[0]] != 0)
        rank = np.empty(len(text), np.int64)
        rank[order] = ranked
        k *= 2
    return order


def spans_of(words: Words, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered stretches (text, first word, end) of each text, numbered within the text."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    covered = np.cumsum(change)[:-1] > 0
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    inner = words.bounds[1:-1][(words.bounds[1:-1] > 0) & (words.bounds[1:-1] < len(words))]
    both = inner[covered[inner - 1] & covered[inner]]  # a stretch ends where its text ends
    lo = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.unique(both)]))
    hi = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.unique(both)]))
    text = np.searchsorted(words.bounds, lo, "right") - 1
    return text, lo - words.bounds[text], hi - words.bounds[text]


def matches_of(tests: TestSuffixes, words: Words) -> np.ndarray:
    """Longest verbatim matches, sorted rows (text, item_id, start, item_start, n_words): windows
    that follow each other in the document and in the item are one match."""
    at, number = tests.occurrences(words)
    many = tests.per_window[number]
    which = ragged(tests.first_owner[number], many)
    at, size = np.repeat(at, many), np.repeat(tests.sizes[number], many)
    owner, place = tests.owner[which], tests.place[which]
    text = np.searchsorted(words.bounds, at, "right") - 1
    order = np.lexsort((at, at - place, owner, text))
    at, size, owner, place, text = (x[order] for x in (at, size, owner, place, text))
    new = np.ones(len(at), bool)
    if len(at):
        same = (text[1:] == text[:-1]) & (owner[1:] == owner[:-1]) & (at[1:] - place[1:] == at[:-1] - place[:-1])
        new[1:] = ~(same & (at[1:] == at[:-1] + 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(at) else head
    length = at[tail] + size[tail] - at[head]
    found = np.stack([text[head], tests.items[owner[head]], at[head] - words.bounds[text[head]], place[head], length], axis=1)
    return np.unique(found, axis=0) if len(found) else found.astype(np.int64)


def block_of(items: DataFrame, number: int, count: int, window: int):
    """One of ``count`` blocks of the benchmark, broadcast."""
    own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).collect()
    block = TestSuffixes([r[0] for r in own], [r[1] for r in own], window)
    return items.sparkSession.sparkContext.broadcast(block)


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _search(docs: DataFrame, benchmark: DataFrame, schema: str, finish: Callable, window: int, block_bytes: int):
    """Rows of ``finish(batch, words, matches)`` for all batches. A benchmark of one block is searched
    in one pass that shuffles nothing. A larger one takes a pass for each block, one after another,
    so that one block at a time is on the driver and the executors; the rows are stored with numbers
    for it, and what the passes find in a few of them is joined by number."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    if count == 1:
        block = block_of(items, 0, 1, window)

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words = Words(batch["text"], PUNCTUATION, lower=True)
                yield finish(batch, words, matches_of(block.value, words))

        return docs.mapInArrow(one_pass, schema)

    row, held = _fresh("row", docs.columns), _fresh("matches", docs.columns)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))

    def in_block(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = matches_of(block.value, Words(batch["text"], PUNCTUATION, lower=True))
                per_text = np.bincount(found[:, 0], minlength=batch.num_rows)
                hit = per_text > 0
                lists = list_array(found[:, 1:].ravel(), 4 * per_text[hit], pa.int64())
                yield pa.RecordBatch.from_arrays([batch[row].filter(pa.array(hit)), lists], [row, held])

        return rows.select(row, "text").mapInArrow(run, f"`{row}` long, `{held}` array<bigint>")

    parts = []
    for k in range(count):
        block = block_of(items, k, count, window)
        parts.append(stored(in_block(block)))
        block.unpersist()
    united = reduce(DataFrame.unionByName, parts).groupBy(row).agg(F.flatten(F.collect_list(held)).alias(held))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch[held].fill_null([])
            values = pa.compute.list_flatten(lists).to_numpy().reshape(-1, 4)
            text = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy() // 4)
            yield finish(batch, Words(batch["text"], PUNCTUATION, lower=True), np.unique(np.column_stack([text, values]), axis=0))

    return rows.join(united, row, "left").mapInArrow(last, schema)


def _covered(words: Words, matches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans_of(words, matches[:, 2] + words.bounds[matches[:, 0]], matches[:, 4])


def _hits(covered, rows: int) -> np.ndarray:
    return np.bincount(covered[0], weights=covered[2] - covered[1], minlength=rows).astype(np.int64)


def is_contaminated(hits: np.ndarray, words: np.ndarray, share: int) -> np.ndarray:
    return (hits > 0) & (share * hits >= words)


_MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES):
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    items (sorted as text), spans (covered stretches of words, [start, end) pairs), matches (longest
    verbatim matches: item_id, start, item_start, n_words) and n_longest (words of the longest one).

    A document is contaminated if ``share * n_hit >= n_words`` with a hit. Null and empty texts
    have no words and no hits; repeated rows give repeated results; an empty benchmark hits
    nothing; other columns aren't read. An item without id or text holds no window; the same id on
    several rows is one item.
    """
    schema = (
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "items array<string>, spans array<struct<start: bigint, end: bigint>>, "
        "matches array<struct<item_id: bigint, start: bigint, item_start: bigint, n_words: bigint>>, n_longest long"
    )

    def finish(batch, words, matches):
        covered = _covered(words, matches)
        hits = _hits(covered, batch.num_rows)
        found = np.unique(matches[:, :2], axis=0)
        per_text = np.bincount(found[:, 0], minlength=batch.num_rows)
        names: list[list[str]] = [[] for _ in range(batch.num_rows)]
        for text, item in found.tolist():
            names[text].append(str(item))
        names = [sorted(n) for n in names]
        stretches: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for text, lo, hi in zip(*(c.tolist() for c in covered)):
            stretches[text].append({"start": lo, "end": hi})
        longest = np.zeros(batch.num_rows, np.int64)
        np.maximum.at(longest, matches[:, 0], matches[:, 4])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(matches[:, 0], minlength=batch.num_rows))]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(matches[:, k].astype(np.int64)) for k in range(1, 5)], fields=list(_MATCH))
        return pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(words.counts, pa.int64()),
                pa.array(hits),
                pa.array(per_text, pa.int64()),
                pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]),
                pa.array(is_contaminated(hits, words.counts, share)),
                pa.array(names, pa.list_(pa.string())),
                pa.array(stretches, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.ListArray.from_arrays(pa.array(offsets), structs),
                pa.array(longest),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "matches", "n_longest"],
        )

    return _search(docs.select("doc_id", "text"), benchmark, schema, finish, window, block_bytes)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES):
    """The rows of ``docs``, all columns, whose text isn't contaminated (see ``report``)."""

    names = docs.columns

    def finish(batch, words, matches):
        clean = ~is_contaminated(_hits(_covered(words, matches), batch.num_rows), words.counts, share)
        return batch.select(names).filter(pa.array(clean))

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _search(docs, benchmark, plain, finish, window, block_bytes)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """One row for each longest verbatim match: doc_id, item_id, doc_start, item_start, n_words."""
    found = report(docs, benchmark, window, block_bytes=block_bytes).select("doc_id", F.inline("matches"))
    return found.withColumnRenamed("start", "doc_start")
