import random
import re
import zlib
from collections import Counter
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from promptloom.llm import quality
from promptloom.llm.queries import QUERIES

from .conftest import nasty_texts, rows_of, table

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("text", T.StringType())])


def plain(text):
    """Some features, one text at a time."""
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, counts = max(len(w), 1), Counter(w)
    runs = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    lines = re.findall(rb"[^\n\r]+", raw)
    return {
        "bytes": log1p(len(raw)),
        "words": log1p(len(w)),
        "word_bytes": sum(map(len, w)) / n,
        "word_spread": float(np.std([len(x) for x in w])) if w else 0.0,
        "distinct_words": len(counts) / n,
        "top_word": max(counts.values(), default=0) / n,
        "twice_running": sum(a == b for a, b in zip(w, w[1:])) / n,
        "distinct_runs": len(runs) / max(len(w) - 2, 1),
        "words_a_line": log1p(len(w) / max(len(lines), 1)),
        "word_entropy": -sum(c / n * log(c / n) for c in counts.values()),
        "capital_words": sum(x[:1].isupper() for x in w) / n,
        "upper_words": sum(len(re.findall(rb"[A-Z]", x)) > 1 and not re.search(rb"[a-z]", x) for x in w) / n,
        "marked_ends": sum(x[-1:] in b"#$%&*+/<=>@[\\]^_`{|}~" for x in w) / n,
        "stopped_ends": sum(x[-1:] in b".,;:!?'\"()-" for x in w) / n,
        "digits": sum(48 <= b < 58 for b in raw) / max(len(raw), 1),
        "marks": sum(bytes([b]) in b"#$%&*+/<=>@[\\]^_`{|}~" for b in raw) / max(len(raw), 1),
    }


def test_features_are_the_plain_ones():
    texts = nasty_texts() + ["ABC! AB#\nAB# x1 X", "one\none\r\n\ntwo", "A", "12 34"]
    found = quality.features(pa.array(texts))
    for text, row in zip(texts, found):
        ours = dict(zip(quality.FEATURES, row))
        for name, value in plain(text).items():
            assert abs(ours[name] - value) < 1e-9, (name, text[:40])
    assert (found[texts.index(None)] == 0).all() and (found[texts.index("")] == 0).all()
    assert quality.features(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))
    one = np.vstack([quality.features(pa.array([t], pa.string())) for t in texts])
    np.testing.assert_allclose(one, found, atol=1e-12)  # batches don't matter


def every_cut(g, h):
    """Gain of the best cut of ranges in two, by trying all."""
    worth = lambda a, b: a.sum() ** 2 / (b.sum() + quality.RIDGE)
    gains = [
        worth(g[:k], h[:k]) + worth(g[k:], h[k:]) - worth(g, h)
        for k in range(1, len(g))
        if min(h[:k].sum(), h[k:].sum()) >= quality.LEAST_WEIGHT
    ]
    return max([0.0, *gains])


def test_trees_take_the_best_cuts():
    draw = np.random.default_rng(3)
    for _ in range(50):
        g, h = draw.normal(size=12), draw.uniform(0.1, 1, 12)
        gain, at = quality._best_cut(g, h)
        assert abs(gain - every_cut(g, h)) < 1e-9
        tree = quality.shallow_tree(g, h)
        assert 1 <= len(np.unique(tree)) <= 4
        assert at < 0 or len(set(tree[: at + 1])) <= 2 >= len(set(tree[at + 1 :]))
        for value in np.unique(tree):
            own = tree == value
            assert abs(value + g[own].sum() / (h[own].sum() + quality.RIDGE)) < 1e-9
        g, h = draw.normal(size=(5, 6)), draw.uniform(0.1, 1, (5, 6))
        gain, tree = quality.pair_tree(g, h)
        best = 0.0
        for x, y in ((g, h), (g.T, h.T)):
            for k in range(1, len(x)):
                sides = (x[:k].sum(0), y[:k].sum(0)), (x[k:].sum(0), y[k:].sum(0))
                whole = sum(a.sum() ** 2 / (b.sum() + quality.RIDGE) + every_cut(a, b) for a, b in sides)
                if min(b.sum() for _, b in sides) >= quality.LEAST_WEIGHT:
                    best = max(best, whole - g.sum() ** 2 / (h.sum() + quality.RIDGE))
        assert abs(gain - best) < 1e-9 and tree.shape == g.shape and len(np.unique(tree)) <= 4


def test_pairs_learn_what_single_features_cannot():
    draw = np.random.default_rng(1)
    values = draw.uniform(size=(3000, len(quality.FEATURES)))
    labels = ((values[:, 2] > 0.5) != (values[:, 5] > 0.5)).astype(float)  # either, not both
    model = quality.fit(values[:2000], labels[:2000])
    assert (2, 5) in model.double
    assert ((model.score(values[2000:]) > 0.5) == labels[2000:]).mean() > 0.9
    margin = np.full(1000, model.base)  # a score is a sum of looked-up values
    alone, paired = model.places(values[2000:])
    margin += sum(t[p] for t, p in zip(model.single, alone)) + sum(t[paired[a], paired[b]] for (a, b), t in model.double.items())
    np.testing.assert_allclose(model.margin(values[2000:]), margin)


def test_ties_few_rows_and_one_label():
    empty = np.zeros((0, len(quality.FEATURES)))
    assert quality.fit(empty, np.zeros(0)).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    same = np.ones((50, len(quality.FEATURES)))
    assert abs(quality.fit(same, np.ones(50)).score(same)[0] - 51 / 52) < 1e-9
    mixed = quality.fit(same, np.arange(50) % 2.0)  # equal rows, different labels
    assert np.allclose(mixed.score(same), 0.5)


def junk(draw):
    return "".join(draw.choice("abc #$%") for _ in range(80))


def test_nasty_documents(spark, nasty):
    draw = random.Random(5)
    rows = nasty + [(1000 + k, junk(draw) if k % 3 == 0 else " ".join(draw.choices("the plain words of a long text".split(), k=20))) for k in range(300)]
    rows += [(None, "x"), (2000, junk(draw))] + [(2001, f"a text {k} of one id") for k in range(20)]
    labels = spark.createDataFrame(
        [(1000 + k, int(k % 3 > 0), "x") for k in range(300)] + [(None, 1, "x"), (1000, None, "y"), (2001, 1, "z"), (2001, 0, "z"), (99, 1, "no text")], LABELS
    )
    found = quality.report(table(spark, rows).repartition(4), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in found if r.held_out and 1000 <= r.doc_id < 1300]
    assert all((r.score > 0.5) == ((r.doc_id - 1000) % 3 > 0) for r in held) and held
    again = quality.report(table(spark, rows).repartition(7), labels)
    assert rows_of(again, "doc_id", "score") == sorted(((r.doc_id, r.score) for r in found), key=repr)


def test_held_out_labels_are_not_read(spark):
    rows = [(k, "word " * (1 + k % 7)) for k in range(60)]
    docs = table(spark, rows)
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    labels = [[(k, (k + turn * (k in held)) % 2, "") for k, _ in rows] for turn in (0, 1)]
    first, second = (rows_of(quality.report(docs, spark.createDataFrame(own, LABELS)), "doc_id", "score") for own in labels)
    assert held and first == second


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.report(table(spark, []), none).count() == 0
    assert {r.score for r in quality.report(table(spark, [(1, "a"), (2, None)]), none).collect()} == {0.5}


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r.score for r in QUERIES["op12_quality"](spark, sf).where("held_out").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in found}
    good, bad = ([found[i] for i, q in labels.items() if q == k] for k in (1, 0))
    right = np.mean([[1.0 if g > b else 0.5 * (g == b) for b in bad] for g in good])
    assert right > 0.95, right  # area under the curve
    assert np.mean([g >= 0.3 for g in good]) > 0.97
