"""Quality of texts by a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one for each feature of a text, by ranges of its values, and one
for each of the few pairs of features that say more together. The tables are learned by cyclic
boosting: feature by feature, round after round, a shallow tree is fitted to what the sum still gets
wrong, and a fraction of it is added to that feature's table; then the same for the pairs. Trees are
gone after that, scoring only looks up and adds.

Learning reads a bounded sample of the labelled rows; scoring is map-only over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from promptloom.llm.words import WHITE, Words, sequence_hashes, slices, text_bytes

#: Labelled rows that are learned from: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: Ranges of a feature, alone and in a pair.
BINS, PAIR_BINS = 32, 8
#: Rounds over all features, rounds over all pairs, pairs, and the part of each tree that is added.
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 10, 0.1
#: Pull of leaves to nothing, and the least second derivative of a leaf.
RIDGE, LEAST_WEIGHT = 1.0, 0.5
#: Words of a repeated run.
RUN = 3

# Bytes of each kind.
_KINDS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": bytes(range(48, 58)),
    "white": b"\t\v\f\r ",
    "lines": b"\n",
    "stops": b".,;:!?'\"()-",
    "marks": b"#$%&*+/<=>@[\\]^_`{|}~",
}
FEATURES = [
    "bytes", "words", "word_bytes", "word_spread", "distinct_words", "top_word", "twice_running", "distinct_runs",
    "words_a_line", "distinct_lines", "word_entropy", "capital_words", "upper_words", "marked_ends", "stopped_ends",
    *_KINDS,
]
_IS = {name: np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(kind, np.uint8)) for name, kind in _KINDS.items()}
_NEW_LINE = np.zeros(256, bool)
_NEW_LINE[[0x0A, 0x0D]] = True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    found = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        found[some] = np.add.reduceat(values, bounds[some], dtype=np.float64)
    return found


def _different(text: np.ndarray, names: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: different names, the occurrences of the most frequent, the sum of n log n.
    Names count as equal if they agree in the bits that the numbers of the texts leave free."""
    low = np.uint64(64 - int(count).bit_length())
    keys = np.sort((text.astype(np.uint64) << low) | (names >> np.uint64(int(count).bit_length())))
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    times, own = np.diff(np.append(starts, len(keys))), (keys[starts] >> low).astype(np.int64)
    bounds = np.searchsorted(own, np.arange(count + 1))
    some, top = np.flatnonzero(np.diff(bounds)), np.zeros(count)
    if len(some):
        top[some] = np.maximum.reduceat(times, bounds[some])
    return np.diff(bounds).astype(float), top, _sums(times * np.log(times), bounds)


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; all 0 for a text without bytes."""
    count = len(texts)
    raw, ends = text_bytes(texts)
    words = Words(texts, WHITE)
    n, size = np.maximum(words.counts, 1), np.maximum(np.diff(ends), 1)
    lengths = np.diff(words.offsets).astype(float)
    own = {"bytes": np.log1p(np.diff(ends)), "words": np.log1p(words.counts)}
    own["word_bytes"] = _sums(lengths, words.bounds) / n
    own["word_spread"] = np.sqrt(np.maximum(_sums(lengths**2, words.bounds) / n - own["word_bytes"] ** 2, 0))
    hashes, text = words.hashes(), words.text_of()
    distinct, top, spread = _different(text, hashes, count)
    own["distinct_words"], own["top_word"] = distinct / n, top / n
    own["word_entropy"] = np.where(words.counts > 0, np.log(n) - spread / n, 0.0)
    same = np.zeros(len(words))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    own["twice_running"] = _sums(same, words.bounds) / n
    runs = sequence_hashes(hashes, RUN)
    whole = np.flatnonzero(text[: len(runs)] == text[RUN - 1 :]) if len(runs) else np.zeros(0, np.int64)
    own["distinct_runs"] = _different(text[whole], runs[whole], count)[0] / np.maximum(words.counts - RUN + 1, 1)
    lines = Words(texts, _NEW_LINE)
    own["words_a_line"] = np.log1p(words.counts / np.maximum(lines.counts, 1))
    own["distinct_lines"] = _different(lines.text_of(), lines.hashes(), count)[0] / np.maximum(lines.counts, 1)
    head, tail = words.data[words.offsets[:-1]], words.data[np.maximum(words.offsets[1:], 1) - 1]
    own["capital_words"] = _sums(_IS["upper"][head], words.bounds) / n
    uppers = np.add.reduceat(_IS["upper"][words.data], words.offsets[:-1], dtype=np.int64) if len(words) else np.zeros(0)
    lowers = np.add.reduceat(_IS["lower"][words.data], words.offsets[:-1], dtype=np.int64) if len(words) else np.zeros(0)
    own["upper_words"] = _sums((uppers > 1) & (lowers == 0), words.bounds) / n
    own["marked_ends"] = _sums(_IS["marks"][tail], words.bounds) / n
    own["stopped_ends"] = _sums(_IS["stops"][tail], words.bounds) / n
    for name, table in _IS.items():
        own[name] = _sums(table[raw], ends) / size
    return np.column_stack([own[name] for name in FEATURES]) if count else np.zeros((0, len(FEATURES)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Between equal shares of the values; fewer where values are equal."""
    if not len(values):
        return np.zeros(0)
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


class Tables:
    """The model: ``score`` is the chance of label 1."""

    def __init__(self, base: float, cuts: list[np.ndarray], pair_cuts: list[np.ndarray]):
        self.base, self.cuts, self.pair_cuts = base, cuts, pair_cuts
        self.single = [np.zeros(len(c) + 1) for c in cuts]
        self.double: dict[tuple[int, int], np.ndarray] = {}

    def places(self, values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The range of each value, in the features' own tables and in those of pairs."""
        alone = [np.searchsorted(c, values[:, f], "left") for f, c in enumerate(self.cuts)]
        return alone, [np.searchsorted(c, values[:, f], "left") for f, c in enumerate(self.pair_cuts)]

    def margin(self, values: np.ndarray) -> np.ndarray:
        alone, paired = self.places(values)
        total = np.full(len(values), self.base)
        for table, place in zip(self.single, alone):
            total += table[place]
        for (a, b), table in self.double.items():
            total += table[paired[a], paired[b]]
        return total

    def score(self, values: np.ndarray) -> np.ndarray:
        return _chance(self.margin(values))


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _worth(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, last range on the left side) of the best cut of ranges in two, or (0, -1)."""
    if len(g) < 2:
        return 0.0, -1
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = _worth(left_g, left_h) + _worth(right_g, right_h) - _worth(g.sum(), h.sum())
    gain = np.where((left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, 0.0)
    at = int(np.argmax(gain))
    return (float(gain[at]), at) if gain[at] > 1e-9 else (0.0, -1)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by range of the greedy tree of depth two: the best cut, then the best in each half."""
    _, at = _best_cut(g, h)
    values = np.empty(len(g))
    for lo, hi in ((0, at + 1), (at + 1, len(g))):
        if lo == hi:
            continue
        _, inner = _best_cut(g[lo:hi], h[lo:hi])
        for a, b in ((lo, lo + inner + 1), (lo + inner + 1, hi)):
            if a < b:
                values[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return values


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values by both ranges) of the better tree of depth two that cuts one feature, then
    the other on each side."""
    found = []
    for turned in (False, True):
        x, y = (g.T, h.T) if turned else (g, h)
        # all first cuts at once: sums of ranges of the second feature, left of each cut and right of it
        left_g, left_h = np.cumsum(x, axis=0)[:-1], np.cumsum(y, axis=0)[:-1]
        best, tree = 0.0, np.full(x.shape, -g.sum() / (h.sum() + RIDGE))
        for at in range(len(x) - 1):
            sides = (left_g[at], left_h[at]), (x.sum(axis=0) - left_g[at], y.sum(axis=0) - left_h[at])
            if min(s[1].sum() for s in sides) < LEAST_WEIGHT:
                continue
            cuts = [_best_cut(*s) for s in sides]
            gain = sum(_worth(s[0].sum(), s[1].sum()) for s in sides) + sum(c[0] for c in cuts) - _worth(g.sum(), h.sum())
            if gain > best:
                best, tree = gain, np.empty(x.shape)
                for rows, (sg, sh), (_, inner) in zip((slice(0, at + 1), slice(at + 1, None)), sides, cuts):
                    for part in (slice(0, inner + 1), slice(inner + 1, None)):
                        tree[rows, part] = -sg[part].sum() / (sh[part].sum() + RIDGE)
        found.append((best, tree.T if turned else tree))
    return max(found, key=lambda f: f[0])


def fit(values: np.ndarray, labels: np.ndarray) -> Tables:
    """Tables for rows of features and labels 0 or 1. Without rows, or with one label only, they are
    empty and every text gets the share of label 1, one row of each label added."""
    ones = float(labels.sum())
    base = float(np.log((ones + 1) / (len(labels) - ones + 1)))
    cuts = [cut_points(v, BINS) for v in values.T] if len(values) else [np.zeros(0)] * len(FEATURES)
    coarse = [cut_points(v, PAIR_BINS) for v in values.T] if len(values) else [np.zeros(0)] * len(FEATURES)
    model = Tables(base, cuts, coarse)
    if not 0 < ones < len(labels):
        return model
    alone, paired = model.places(values)
    margin = np.full(len(labels), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _chance(margin)
        return p - labels, p * (1 - p)

    for _ in range(ROUNDS):
        for f, place in enumerate(alone):
            g, h = slopes()
            size = len(model.single[f])
            step = RATE * shallow_tree(np.bincount(place, g, size), np.bincount(place, h, size))
            model.single[f] += step
            margin += step[place]
    g, h = slopes()

    def grid(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        rows, columns = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(paired[a] * columns + paired[b], weights, rows * columns).reshape(rows, columns)

    rated = [(pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(range(len(coarse)), 2)]
    chosen = sorted((r for r in rated if r[0] > 0), key=lambda r: (-r[0], r[1:]))[:PAIRS]
    for _, a, b in chosen:
        model.double[a, b] = np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))
    for _ in range(PAIR_ROUNDS):
        for _, a, b in chosen:
            g, h = slopes()
            step = RATE * pair_tree(grid(a, b, g), grid(a, b, h))[1]
            model.double[a, b] += step
            margin += step[paired[a], paired[b]]
    return model


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = features(batch["text"])
        offsets = pa.array(np.arange(0, found.size + 1, len(FEATURES), dtype=np.int32))
        vectors = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], vectors], ["doc_id", "label", "vector"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Tables:
    """Tables from at most ``rows`` labelled documents that aren't held out. The ids of the sample (12
    bytes a row) are broadcast; the driver gets the features of its different texts (``rows`` at most).
    Of several labels of a document the smaller counts, of several texts of an id one."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = F.broadcast(ids.select(F.col("doc_id").alias("labelled_id"), F.col("label").cast("int").alias("label")))
    own = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("labelled_id")).select("doc_id", "label", "text")
    found = own.mapInArrow(_described, "doc_id long, label int, vector array<double>")
    one = found.groupBy("doc_id").agg(F.min(F.struct("vector", "label")).alias("r"))
    # copies of a text would else outweigh all others
    sample = one.groupBy("r.vector").agg(F.min("r.label").alias("label")).orderBy("vector").toArrow()
    values = np.array(sample["vector"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(values, sample["label"].to_numpy().astype(float))


def score_documents(docs: DataFrame, model: Tables) -> DataFrame:
    """doc_id, score of every row; the model (its tables, a few hundred kB at most) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = shared.value.score(features(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from ``labels`` that aren't held out.

    A null text is scored like an empty one. Rows with a null doc_id are scored and not held out;
    repeated rows give repeated results. Without labels every text gets 0.5.
    """
    scored = score_documents(docs, learn(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
