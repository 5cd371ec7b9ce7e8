import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from promptloom.llm import divergence
from promptloom.llm.queries import QUERIES

from .conftest import nasty_texts, rows_of

NAMES = ("lang", "source", "part", "item", "value", "rank")
TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "source", "term", "value")] + [T.StructField("n", T.LongType())])


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], TYPE)


def terms_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(rows, least=30, top=50):
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(terms_of(text))
        held[lang or ""].update(found.keys())
        counts[lang or "", source or ""].update(found)
    results = []
    for lang in held:
        kept = [t for t, d in held[lang].items() if d >= least]
        groups = sorted(s for l, s in counts if l == lang)

        def share(own):
            whole = sum(own[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 5) // whole for t in kept}

        p = {s: share(counts[lang, s]) for s in groups}
        q = share(sum((counts[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            lifts = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", lifts, top)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                results += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(results, key=repr)


def random_rows(seed, count=300, alphabet=40, sources=6):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdé", k=draw.randint(1, 4))) for _ in range(alphabet)]
    rows = []
    for _ in range(count):
        s = draw.randrange(sources)
        text = " ".join(draw.choices(words[s : s + 25], k=draw.randint(0, 40)))
        rows.append((text, draw.choice(["en", "de", None]), f"s{s}" if s else None))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_random_documents(spark, seed):
    rows = random_rows(seed)
    assert rows_of(divergence.audit(documents(spark, rows).repartition(5)), *NAMES) == expected(rows)


def test_nasty_documents(spark):
    draw = random.Random(4)
    rows = [(t, draw.choice(["en", "", None]), draw.choice(["a", "b", "", None, "ü"])) for t in nasty_texts()]
    rows += rows[:9] + [(None, "fr", "lonely"), ("", "es", "one"), (None, "es", "two"), ("x " * 40000, "en", "a")]
    assert rows_of(divergence.audit(documents(spark, rows), least=3, top=4), *NAMES) == expected(rows, 3, 4)


def test_empty_tables(spark):
    assert divergence.audit(documents(spark, [])).count() == 0
    rows = [(None, None, None), (None, None, "b")]
    assert rows_of(divergence.audit(documents(spark, rows)), *NAMES) == expected(rows)


def test_many_sources_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_SOURCES", 3)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 8)
    monkeypatch.setattr(divergence, "WALKED", 64)
    rows = random_rows(9, count=400, alphabet=80, sources=13)
    assert rows_of(divergence.audit(documents(spark, rows), least=5), *NAMES) == expected(rows, 5)


def test_forest_shares_equal_subtrees():
    draw = np.random.default_rng(1)
    counts = draw.integers(0, 3, (7, 300))
    counts[3] = counts[1]
    counts[5, 64:256] = counts[1, 64:256]
    forest = divergence.Forest(counts)
    assert forest.roots[3] == forest.roots[1] != forest.roots[5]
    assert len(forest.leaves) == 4  # 0, 1, 2 and beyond the end
    assert all(len(one) <= 3**2**k + 8 for k, (one, _) in enumerate(forest.halves, 1))
    whole = counts.sum(axis=1) + 5 * 300
    a, b = np.triu_indices(7, 1)
    sums, priced = forest.distances(a, b, whole)
    for i, j, value in zip(a, b, sums):
        plain = sum(abs(10**9 * (int(x) + 5) // int(whole[i]) - 10**9 * (int(y) + 5) // int(whole[j])) for x, y in zip(counts[i], counts[j]))
        assert value == plain
    assert priced <= 9 * len(a)  # of 300 ids each


def test_shares_are_exact():
    draw = random.Random(2)
    whole = [draw.randrange(10, 2**53) for _ in range(2000)] + [5, 2**53 - 1]
    counts = [draw.randrange(0, w - 4) for w in whole[:-2]] + [0, 2**53 - 6]
    ours = divergence.shares(np.array(counts), np.array(whole))
    assert ours.tolist() == [1 + 10**9 * (c + 5) // w for c, w in zip(counts, whole)]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]
    ours = QUERIES["op11_divergence"](spark, sf)
    assert rows_of(ours, *NAMES) == expected(rows)
