import math

import numpy as np
import pytest

from promptloom.llm import neighbours
from promptloom.llm.queries import QUERIES

TYPE = "vec_id long, embedding array<float>, label int, score double, rank int"
QUERY = "vec_id % 20 = 0"


def vectors(session, rows):
    return session.createDataFrame([(i, v, None, 0.5, 1) for i, v in rows], TYPE)


def valid(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def exact(rows, top=20):
    own = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and valid(v)]
    found = {}
    for q, v in own:
        if q % 20 == 0:
            near = sorted(((-float(np.add.reduce(x * v)), i) for i, x in own if i != q and len(x) == len(v)))[:top]
            found[q] = [(i, -s) for s, i in near]
    return found


def by_query(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def random_rows(n, size, seed=0, groups=0):
    draw = np.random.default_rng(seed)
    points = draw.normal(size=(n, size))
    if groups:
        points += 3 * draw.normal(size=(groups, size))[draw.integers(0, groups, n)]
    return [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]


def test_everything_probed_is_exact(spark):
    rows = random_rows(300, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # ties
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (None, rows[1][1])]
    rows += [(2100 + i, [1.0, float(i)]) for i in range(70)] + [(2200, [1.0])]  # other lengths, each among its own
    ours = by_query(neighbours.search(vectors(spark, rows), QUERY, group_rows=60, wanted=2.0))
    want = exact(rows)
    assert ours == {k: v for k, v in want.items() if v}
    assert [i for i, _ in ours[2100]][:1] == [2101] and 2200 not in ours  # no other of its length


def test_parts_grow_with_the_square_root_of_the_rows():
    assert [neighbours.parts_for(n) for n in (0, 100, 2_000, 10_000, 160_000, 10**12)] == [8, 8, 32, 64, 256, 512]


def test_few_rows(spark):
    assert neighbours.search(vectors(spark, []), QUERY).count() == 0
    assert neighbours.search(vectors(spark, [(0, [1.0, 0.0])]), QUERY).count() == 0
    ours = by_query(neighbours.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])]), QUERY))
    assert ours == {0: [(1, 0.5), (2, 0.5)]}


@pytest.mark.parametrize("groups", [0, 40])
def test_recall(spark, groups):
    rows = random_rows(4000, 16, 1, groups)
    ours = by_query(neighbours.search(vectors(spark, rows), QUERY))
    want = exact(rows)
    assert ours.keys() == want.keys()
    recall = np.mean([len({i for i, _ in ours[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_grouped_vectors_need_few_parts(spark):
    rows = random_rows(4000, 16, 2, 40)
    router = neighbours.learn(neighbours.valid_vectors(vectors(spark, rows)), 16, 20)
    assert 1 <= router.probes <= 10


def test_parts_are_balanced():
    points = np.random.default_rng(5).normal(size=(1000, 8))
    graph = neighbours.neighbour_graph(points, 10)
    part = neighbours.balanced_parts(points, graph, 8)
    assert np.bincount(part, minlength=8).max() <= 125
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 0.2


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ours, want = by_query(QUERIES["op5_neighbours"](spark, sf)), exact(rows)
    assert ours.keys() == want.keys() and all(len(v) == 20 for v in ours.values())
    assert np.mean([len({i for i, _ in ours[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
