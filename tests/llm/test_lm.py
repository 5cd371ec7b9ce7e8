import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from promptloom.llm import lm
from promptloom.llm.eliasfano import EliasFano, Trie, probability, quantised
from promptloom.llm.queries import QUERIES

from .conftest import nasty_texts, rows_of, table

HELD_OUT = "crc32(cast(doc_id AS string)) % 10 = 0"
D = lm.DISCOUNT


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class Plain:
    """The same model from plain counts."""

    def __init__(self, rows):
        self.one, self.two, self.three, self.before, self.after = (Counter() for _ in range(5))
        for i, text in rows:
            if is_held_out(i):
                continue
            t = ["<<", "<", *tokens(text)]
            for u, v, w in zip(t, t[1:], t[2:]):
                self.one[w] += 1
                self.two[v, w] += 1
                self.three[u, v, w] += 1
                self.before[u, v] += 1
                self.after[v] += 1
        self.kinds2, self.kinds3 = Counter(v for v, _ in self.two), Counter((u, v) for u, v, _ in self.three)
        self.n, self.v = sum(self.one.values()), len(self.one)

    def base(self, w):
        return (self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, u, v, w):
        p = self.base(w)
        if self.after[v]:
            p = (max(self.two[v, w] - D, 0) + D * self.kinds2[v] * p) / self.after[v]
        if self.before[u, v]:
            p = (max(self.three[u, v, w] - D, 0) + D * self.kinds3[u, v] * p) / self.before[u, v]
        return p


def expected(rows):
    model = Plain(rows)
    found = []
    for i, text in rows:
        t = tokens(text)
        full = ["<<", "<", *t]
        score = sum(math.log10(model.p(*x)) for x in zip(full, full[1:], full[2:]))
        known = sum(model.one[w] > 0 for w in t)
        found.append((i, is_held_out(i), len(t), known, model.n, sum(math.log10(model.base(w)) for w in t), score))
    return found


def compare(ours, want, score_too=True):
    key = lambda r: repr(tuple(r)[:5])
    ours, want = sorted(map(tuple, ours), key=key), sorted(want, key=key)
    assert [r[:5] for r in ours] == [r[:5] for r in want]
    # Rows that are equal up to here may differ in order; their figures are compared as sorted.
    for k, wide in ((5, 1e-9), (6, 2e-4)) if score_too else ((5, 1e-9),):
        a, b = sorted((r[:5], r[k]) for r in map(lambda r: (repr(r[0]), *r[1:]), ours)), sorted((r[:5], r[k]) for r in map(lambda r: (repr(r[0]), *r[1:]), want))
        for (_, x), (head, y) in zip(a, b):
            assert x == pytest.approx(y, rel=wide, abs=wide * head[2])


def test_nasty_documents(spark, nasty):
    rows = list(nasty) + [(None, "null ids count as learned"), (None, None)]
    compare(lm.score_documents(table(spark, rows), HELD_OUT, frequent_most=0).collect(), expected(rows))


def test_frequent_words_keep_the_counts(spark, nasty):
    ours = lm.score_documents(table(spark, nasty).repartition(3), HELD_OUT).collect()
    compare(ours, expected(nasty), score_too=False)


def test_scores_of_frequent_words_are_the_whole_models(spark, nasty):
    for parts in (1, 3):
        ours = lm.score_documents(table(spark, nasty).repartition(parts), HELD_OUT).collect()
        compare(ours, expected(nasty))


def test_query_at_production_parameters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert len(lm.frequent_words(docs)) > 20
    compare(QUERIES["op1_lm"](spark, sf).collect(), expected([tuple(r) for r in docs.collect()]))


def test_empty_tables(spark):
    assert lm.score_documents(table(spark, []), HELD_OUT).count() == 0
    rows = [(i, "a b") for i in range(200) if is_held_out(i)][:3]  # nothing to learn from
    compare(lm.score_documents(table(spark, rows), HELD_OUT).collect(), expected(rows))


def test_query(spark, sf):
    stored = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    ours = QUERIES["op1_lm"](spark, sf).collect()
    compare(ours, expected(stored), score_too=False)
    held = [r for r in ours if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_elias_fano():
    draw = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (1, 2**63), (1000, 10), (1000, 2**40), (5000, 2**63)):
        values = np.sort(draw.integers(0, most, n, dtype=np.uint64))
        kept = EliasFano.of(values)
        assert (kept.values() == values).all()
        wanted = np.concatenate([values[::3], draw.integers(0, most, 50, dtype=np.uint64)])
        at, equal = kept.successors(wanted)
        assert (at == np.searchsorted(values, wanted)).all() and (equal == np.isin(wanted, values)).all()
        if n >= 1000:
            assert 8 * (kept.lows.nbytes + kept.highs.nbytes) <= n * (3 + max(1, math.log2(max(2, most / n)))) + 128
            assert kept.samples.nbytes + kept.places.nbytes <= n / 4 + 16
        some = draw.integers(0, n, 20) if n else np.zeros(0, np.int64)
        assert (kept.at(some) == values[some]).all()


def test_a_search_reads_its_block_only(monkeypatch):
    draw = np.random.default_rng(4)
    values = np.sort(draw.integers(0, 2**60, 300_000, dtype=np.uint64))
    kept, read = EliasFano.of(values), []
    plain = EliasFano._span
    monkeypatch.setattr(EliasFano, "_span", lambda self, lo, hi: read.append(hi - lo) or plain(self, lo, hi))
    wanted = values[[5, 100_000, 299_999]]
    assert kept.successors(wanted)[0].tolist() == [5, 100_000, 299_999]
    assert sum(read) <= 2 * len(wanted)  # blocks of 64 values
    read.clear()
    assert (kept.successors(values)[0] == np.searchsorted(values, values)).all()
    assert max(read) <= 2048 and sum(read) <= len(values) / 64 + 1  # all blocks once, a few at a time


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(2)
    words = np.sort(draw.integers(0, 2**63, 12, dtype=np.uint64))
    m, u, w = (words[draw.integers(0, 12, 400)] for _ in range(3))
    rows = sorted(set(zip(m.tolist(), (u >> np.uint64(32)).tolist(), (w >> np.uint64(32)).tolist())))
    middle = np.array([r[0] for r in rows], np.uint64)
    first, last = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    trie = Trie(middle, first, last, draw.integers(1, 5, len(rows)), D)
    single = np.full(12, 1 / 12)
    for v in [*words[:6], np.uint64(5)]:
        for b in [*words[:6], np.uint64(7 << 32)]:
            a, rest = trie.query(np.full(12, v), np.full(12, b >> np.uint64(32)), words >> np.uint64(32))
            assert (a + rest * single).sum() == pytest.approx(1, abs=2e-3)


def test_quantised():
    values = np.array([1.0, 0.5, 1e-3, 1e-12, 0.0])
    assert probability(quantised(values)) == pytest.approx(values, rel=2e-4)


def test_texts():
    found = lm.Tokens(pa.array(["A b", None, "c"]))
    assert found.counts.tolist() == [3, 1, 2] and len(nasty_texts()) > 50
    assert rows_of is not None
