import random
import re

import numpy as np
import pyarrow as pa
import pytest

from promptloom.llm import jaccard
from promptloom.llm.components import components
from promptloom.llm.queries import QUERIES

from .conftest import rows_of, table

NAMES = ("doc_id", "n_shingles", "component_id")


def shingles(text, size=4):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def expected(rows, similarity=85):
    sets = [(i, shingles(t)) for i, t in rows]
    group = {i: i for i, _ in sets if i is not None}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    filled = [(i, s) for i, s in sets if s and i is not None]
    holders = {}
    for k, (_, s) in enumerate(filled):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(filled):
        near = {}
        for x in s:
            for j in holders[x]:
                if j > k:
                    near[j] = near.get(j, 0) + 1
        for j, both in near.items():
            if 100 * both >= similarity * (len(s) + len(filled[j][1]) - both):
                a, b = root(i), root(filled[j][0])
                group[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i) if s else i) for i, s in sets), key=repr)


def copies(seed, groups=25, most=8, words=300, sizes=(3, 200), edits=0.08):
    """Groups of near copies with edits at random places, so that many pairs are close to the limit."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    passage = " ".join(draw.choices(vocabulary, k=12))
    texts = []
    for _ in range(groups):
        base = draw.choices(vocabulary, k=draw.randint(*sizes))
        for _ in range(draw.randint(1, most)):
            w = list(base)
            for _ in range(draw.randint(0, max(1, int(edits * len(w))))):
                at = draw.randrange(len(w))
                change = draw.choice(["x", "del", "ins"])
                if change == "x":
                    w[at] = draw.choice(vocabulary)
                elif change == "ins":
                    w.insert(at, draw.choice(vocabulary))
                elif len(w) > 1:
                    del w[at]
            texts.append(" ".join(w) + (" " + passage if draw.random() < 0.3 else ""))
    draw.shuffle(texts)
    return texts


def test_nasty_documents(spark, nasty):
    rows = [(i, t) for i, t in nasty] + [(None, "one two three four"), (None, None)]
    assert rows_of(jaccard.near_duplicates(table(spark, rows)), *NAMES) == expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = [(7 * i + 3, t) for i, t in enumerate(copies(seed))]
    ours = jaccard.near_duplicates(table(spark, rows).repartition(5))
    want = expected(rows)
    assert rows_of(ours, *NAMES) == want
    assert len({r[2] for r in want}) < len(rows)


def test_chains_and_hot_hubs(spark):
    draw = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for _ in range(150):  # a chain of near copies that drift, and strangers
        base[draw.randrange(60)] = f"c{draw.randrange(10**6)}"
        texts.append(" ".join(base))
    rows = list(enumerate(texts + copies(5, groups=4)))
    draw.shuffle(rows)
    ours = jaccard.near_duplicates(table(spark, rows).repartition(3), hub_pairs=3)
    assert rows_of(ours, *NAMES) == expected(rows)


def test_common_hashes_of_rows():
    draw = np.random.default_rng(6)
    rows = []
    for size in (0, 1, 5, 300, 300):
        a = np.unique(draw.integers(0, 2**62, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[::2], draw.integers(0, 2**62, size, dtype=np.uint64), a[:3] ^ np.uint64(1)]))  # near misses
        rows.append((a, b))
    columns = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
    found = jaccard._common(*columns)
    assert found.tolist() == [len(set(a.tolist()) & set(b.tolist())) for a, b in rows]
    assert jaccard._common(*(c.slice(2, 2) for c in columns)).tolist() == found[2:4].tolist()


def far_copies(seed, copies, words=150, edits=9):
    """Copies of one text with so many edits that most share names of fragments but don't link."""
    draw = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    return [" ".join(base)] + [
        " ".join(f"c{draw.randrange(10**6)}" if k in spots else w for k, w in enumerate(base))
        for spots in (set(draw.sample(range(words), draw.randint(2, edits))) for _ in range(copies))
    ]


def test_a_group_that_mostly_does_not_link_costs_its_size(spark, monkeypatch):
    counted, real = [], jaccard.linked

    def linked(pairs, *others):
        counted.append(pairs.count())
        return real(pairs, *others)

    monkeypatch.setattr(jaccard, "linked", linked)
    rows = list(enumerate(far_copies(6, 300)))
    want = expected(rows)
    assert rows_of(jaccard.near_duplicates(table(spark, rows)), *NAMES) == want
    assert 50 < len({r[2] for r in want}) < 280
    assert sum(counted) < 5 * len(rows)


def test_parities_differ_no_more_than_sets():
    texts = copies(12, groups=6) + far_copies(3, 30) + ["", "a", None]
    sets = jaccard.ShingleSets(pa.array(texts))
    bits = np.unpackbits(sets.parities().view(np.uint8), axis=1)
    own = [set(sets.hashes[sets.owner == k].tolist()) for k in range(len(texts))]
    for i, x in enumerate(own):
        for j, y in enumerate(own):
            differ = int((bits[i] != bits[j]).sum())
            assert differ <= len(x ^ y) and (differ - len(x ^ y)) % 2 == 0


def test_sketches_differ_no_more_than_sets():
    draw = random.Random(8)
    long = [f"v{k}" for k in range(3000)]
    texts = [" ".join(draw.sample(long, n)) for n in (0, 100, 140, 260, 270, 500, 600, 1500)] + copies(12, groups=3) + [" ".join(long)]
    texts += [" ".join(w for k, w in enumerate(long) if k % 97) + " more", None]
    sets = jaccard.ShingleSets(pa.array(texts))
    sketches = sets.sketches()
    sizes = [len(x) for x in sketches.to_pylist()]
    assert all(8 * b >= 2 * n if b else n <= 256 for b, n in zip(sizes, sets.sizes.tolist())) and max(sizes) == 1024
    own = [set(sets.hashes[sets.owner == k].tolist()) for k in range(len(texts))]
    at = np.array([(i, j) for i in range(len(texts)) for j in range(len(texts))])
    found = jaccard._differing_bits(*(sketches.take(pa.array(at[:, k])) for k in (0, 1)))
    assert found.tolist() == jaccard._differing_bits(*(sketches.take(pa.array(at[:, k])).slice(0) for k in (1, 0))).tolist()
    for (i, j), differ in zip(at.tolist(), found.tolist()):
        assert differ <= len(own[i] ^ own[j])
        assert not sizes[i] or not sizes[j] or (differ - len(own[i] ^ own[j])) % 2 == 0
    far = at[found == found.max()][0].tolist()
    assert found.max() > 0.8 * min(len(own[far[0]] ^ own[far[1]]), 4 * min(sizes[far[0]], sizes[far[1]]))


def test_only_texts_of_likely_pairs_are_cut(spark, monkeypatch):
    """Long texts that share names but don't link by their sketches are not counted, and are not cut for those that are."""
    cut, counted, real = [], [], jaccard.linked

    def linked(pairs, sets, *others):
        cut.append(sets.select("node").distinct().count())
        counted.append(pairs.count())
        return real(pairs, sets, *others)

    monkeypatch.setattr(jaccard, "linked", linked)
    rows = list(enumerate(far_copies(7, 40, words=1600, edits=260)))
    rows += [(100, rows[5][1] + " and"), (101, rows[9][1] + " more")]
    want = expected(rows)
    assert rows_of(jaccard.near_duplicates(table(spark, rows)), *NAMES) == want
    assert 25 < len({r[2] for r in want}) < 40
    assert sum(counted) < 20 and max(cut) < 30


def test_texts_among_nodes(spark):
    rows = [(k, f"text {k}") for k in range(-203, 3000, 7)] + [(14, "again")]
    docs = table(spark, rows)
    nodes = spark.createDataFrame([(k,) for k in range(0, 2000, 14)], "node long")
    for many in (0, 10, 100_000, 10**9):
        found = jaccard.among(docs, nodes, many)
        assert found.columns == docs.columns
        ids = [r.doc_id for r in found.collect()]
        assert set(range(0, 2000, 14)) & {k for k, _ in rows} <= set(ids)
        assert ids.count(14) == 2
    assert len(ids) < 160
    assert jaccard.among(docs, nodes.limit(0), 100).count() == 0


def test_rows_that_come_twice_count_once(spark):
    words = [f"w{k}" for k in range(200)]
    near = words[:60] + [f"x{k}" for k in range(17)] + words[77:]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (2, " ".join(near)), (1, " ".join(words))]
    texts = table(spark, rows).select("doc_id", "text").withColumnRenamed("doc_id", "node")
    own = [shingles(t) for _, t in rows[:2]]
    assert 0.8 < len(own[0] & own[1]) / len(own[0] | own[1]) < 0.85
    pairs = spark.createDataFrame([(2, 1)], "a long, b long")
    assert jaccard.linked(pairs, jaccard.segments(texts, 4), 85).count() == 0
    assert jaccard.linked(pairs, jaccard.segments(texts, 4), 80).count() == 1


def test_overlaps_are_summed_over_fragments(spark):
    rows = list(enumerate(copies(4, groups=10)))
    texts = table(spark, rows).select("doc_id", "text").withColumnRenamed("doc_id", "node")
    sets = jaccard.segments(texts, 4)
    assert sets.select("fragment").distinct().count() == 4
    pairs = [(a, b) for a, _ in rows for b, _ in rows if a > b]
    own = dict((i, shingles(t)) for i, t in rows)
    for hub_pairs in (2, 1000):
        found = rows_of(jaccard.linked(spark.createDataFrame(pairs, "a long, b long"), sets, 85, hub_pairs), "a", "b")
        assert found == sorted(((a, b) for a, b in pairs if own[a] and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])), key=repr)


def test_one_document_id_with_several_texts(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choices([f"w{k}" for k in range(500)], k=60)) for _ in range(4)]
    near = [t + " more" for t in texts]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[0]), (8, near[1]), (9, texts[2]), (2, near[2]), (2, texts[3]), (11, near[3])]
    assert rows_of(jaccard.near_duplicates(table(spark, rows)), *NAMES) == expected(rows)


def test_frequent_shingles_do_not_matter(spark):
    rows = list(enumerate(copies(3, groups=12)))
    want = expected(rows)
    for share, most in ((0.0, 50_000), (1e9, 50_000), (0.0, 7)):
        ours = jaccard.near_duplicates(table(spark, rows), frequent_share=share, frequent_most=most)
        assert rows_of(ours, *NAMES) == want


def test_linked_sets_share_a_fragment():
    """Of random pairs around the limit every linked one shares a key, for all choices of frequent."""
    draw = np.random.default_rng(2)
    linked = 0
    for _ in range(1500):
        n = int(draw.integers(5, 120))
        base = [f"t{x}" for x in draw.integers(0, 10**6, n)]
        other = [w if draw.random() > 0.03 else f"u{draw.integers(10**6)}" for w in base]
        texts = [" ".join(base), " ".join(other[: n - int(draw.integers(0, 1 + n // 12))])]
        x, y = map(shingles, texts)
        sets = jaccard.ShingleSets(pa.array(texts))
        assert sets.sizes.tolist() == [len(x), len(y)]
        if x == y or 100 * len(x & y) < 85 * len(x | y):
            continue
        linked += 1
        for frequent in (np.zeros(0, np.uint64), np.sort(sets.hashes), np.sort(draw.choice(sets.hashes, n // 2))):
            keys, rows = jaccard.fragment_keys(sets, np.array([True, True]), np.unique(frequent), 85)
            assert set(keys[rows == 0]) & set(keys[rows == 1])
    assert linked > 200


def test_empty_table(spark):
    assert jaccard.near_duplicates(table(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "a")]
    assert rows_of(jaccard.near_duplicates(table(spark, rows)), *NAMES) == expected(rows)


def test_components(spark):
    draw = random.Random(4)
    links = [(a, b) if a > b else (b, a) for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(35)) if a != b]
    links += [(k + 1, k) for k in range(100, 130)]
    group = {n: n for link in links for n in link}
    for _ in range(60):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert rows_of(found, "node", "component") == sorted(group.items(), key=repr)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf):
    stored = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    ours = QUERIES["op7_jaccard"](spark, sf)
    want = expected(stored)
    assert rows_of(ours, *NAMES) == want
    assert any(i != c for i, _, c in want)


def test_first_of_each_component_stays(spark):
    rows = list(enumerate(copies(8, groups=6))) + [(900, None), (901, None)]
    docs = table(spark, rows)
    left = jaccard.keep_first(docs)
    assert left.schema.simpleString() == docs.schema.simpleString()
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, c in expected(rows) if i == c)
