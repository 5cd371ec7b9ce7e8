"""Approximate nearest neighbours by learned partitions.

A bounded sample gives an exact neighbour graph, which is cut into parts of equal size with few
edges between them. A small neural network learns which part a vector's neighbours lie in. Every
row is indexed under its most probable part; a query goes to its several most probable parts, as
many as reach the wanted recall on sample rows the network has not learned from, and all
vectors there are ranked by their inner product in double precision.

Parts are dealt out as (part, salt) groups of bounded size, so a part that holds a third of all
rows is many groups. Equal vectors of a group are ranked once and share their score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Rows that the partition is learned from, those with the smallest hashes of their ids.
SAMPLE_ROWS = 6_000
#: Edges of a row in the neighbour graph.
GRAPH_EDGES = 10
#: Vectors of a group that one task ranks at once.
GROUP_ROWS = 8_000
#: Share of the sample's true neighbours that the probed parts must hold.
WANTED_RECALL = 0.93
#: Parts, at most. Beyond some ten million rows a part, and with it a query's work, grows with the
#: rows; more parts need a larger sample (eight rows a part).
MOST_PARTS = 512


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) without ids or vectors that are null, zero or hold null or non-finite
    components."""
    vector = F.col("embedding")
    fine = embeddings.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return fine.where(~bad & F.exists(vector, lambda x: x != 0))


def usual_length(vectors: DataFrame) -> int:
    """The length that most vectors have, of equal counts the longer; 0 without any."""
    sizes = vectors.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return sizes["size"] if sizes else 0


def neighbour_graph(vectors: np.ndarray, edges: int) -> np.ndarray:
    """For each row the rows with the largest inner products, itself left out."""
    found = np.empty((len(vectors), min(edges, len(vectors) - 1)), np.int64)
    for at in range(0, len(vectors), 1024):
        scores = vectors[at : at + 1024] @ vectors.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        if found.shape[1]:
            near = np.argpartition(-scores, found.shape[1] - 1, axis=1)[:, : found.shape[1]]
            own = np.take_along_axis(scores, near, axis=1)
            found[at : at + 1024] = np.take_along_axis(near, np.argsort(-own, axis=1, kind="stable"), axis=1)
    return found


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Cut the graph into ``parts`` parts of equal size (within one row). Starts from repeated
    halving along the main direction; then rows move to the part most of their neighbours are in,
    those that gain most first, as long as there is room."""
    part = np.zeros(len(vectors), np.int64)
    groups = [np.arange(len(vectors))]
    while len(groups) < parts:
        halves = []
        for rows in groups:
            own = vectors[rows] - vectors[rows].mean(axis=0)
            direction = np.linalg.svd(own, full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(vectors.shape[1])
            order = rows[np.argsort(own @ direction, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = halves
    for number, rows in enumerate(groups):
        part[rows] = number
    room = -(-len(vectors) // parts)
    both = np.concatenate([np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()])
    other = np.concatenate([graph.ravel(), np.repeat(np.arange(len(graph)), graph.shape[1])])
    for _ in range(rounds):
        votes = np.zeros((len(vectors), parts))
        np.add.at(votes, (both, part[other]), 1)
        votes[np.arange(len(part)), part] += 0.5
        gain = votes.max(axis=1) - np.partition(votes, -2, axis=1)[:, -2] if parts > 1 else votes[:, 0]
        left, moved = np.full(parts, room), np.empty_like(part)
        wishes = np.argsort(-votes, axis=1, kind="stable")
        for row in np.argsort(-gain, kind="stable").tolist():
            for wish in wishes[row]:
                if left[wish]:
                    left[wish] -= 1
                    moved[row] = wish
                    break
        if (moved == part).all():
            break
        part = moved
    return part


@dataclass
class Router:
    """One hidden layer; ``rank`` gives the parts of each vector, most probable first."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def rank(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        hidden = np.maximum(unit @ self.w1 + self.b1, 0)
        return np.argsort(-(hidden @ self.w2 + self.b2), axis=1, kind="stable")


def train_router(vectors: np.ndarray, goals: np.ndarray, hidden: int = 96, epochs: int = 30, seed: int = 5) -> Router:
    """Minimises the cross entropy between the router's parts and ``goals`` (shares per part)."""
    draw = np.random.default_rng(seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    size, parts = unit.shape[1], goals.shape[1]
    values = [draw.normal(0, np.sqrt(2 / size), (size, hidden)) * np.sqrt(size), np.zeros(hidden),
              draw.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    means, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(len(unit)), max(1, len(unit) // 128)):
            x, goal = unit[rows], goals[rows]
            raw = x @ values[0] + values[1]
            h = np.maximum(raw, 0)
            out = h @ values[2] + values[3]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - goal) / len(rows)
            dh = (d @ values[2].T) * (raw > 0)
            step += 1
            for k, slope in enumerate((x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                means[k] = 0.9 * means[k] + 0.1 * slope
                squares[k] = 0.999 * squares[k] + 0.001 * slope**2
                values[k] -= 3e-3 * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*values)


def learn(vectors: DataFrame, parts: int, top: int, rows: int = SAMPLE_ROWS, wanted: float = WANTED_RECALL) -> Router:
    """Router from a sample of at most ``rows`` different vectors, collected with their hashes."""
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding").collect()
    sample = np.array([r[0] for r in few], np.float64)
    if not len(sample):
        return Router(np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(3).permutation(len(sample))]
    if parts == 1 or len(sample) < 8 * parts:
        size = sample.shape[1]
        return Router(np.zeros((size, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(sample, GRAPH_EDGES)
    part = balanced_parts(sample, graph, parts)
    goals = np.zeros((len(sample), parts))
    np.add.at(goals, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    goals[np.arange(len(sample)), part] += 0.5
    kept = max(1, len(sample) * 9 // 10)
    router = train_router(sample[:kept], goals[:kept])
    ranked = router.rank(sample)
    near = neighbour_graph(sample, top)[kept:]
    place = np.empty_like(ranked)
    place[np.arange(len(ranked))[:, None], ranked] = np.arange(parts)
    needed = place[np.arange(kept, len(sample))[:, None], ranked[near, 0]]  # rank of each neighbour's part
    reached = [(needed < probes).mean() if needed.size else 1.0 for probes in range(1, parts + 1)]
    router.probes = next((k + 1 for k, share in enumerate(reached) if share >= wanted), parts)
    return router


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, always summed in the same order."""
    return np.add.reduce(vectors * query, axis=1)


def rank_group(queries: pd.DataFrame, vectors: pd.DataFrame, top: int) -> pd.DataFrame:
    """The ``top`` nearest vectors of a group for each query. Candidates come from a matrix product
    with a margin for its rounding; their scores are then summed anew."""
    columns = ["query_id", "vec_id", "score"]
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    points = np.array(vectors["embedding"].tolist(), np.float64)
    different, which = np.unique(points, axis=0, return_inverse=True)
    which = which.ravel()
    ids = vectors["vec_id"].to_numpy()
    order = np.lexsort((ids, which))
    ids, starts = ids[order], np.searchsorted(which[order], np.arange(len(different) + 1))
    asked = np.array(queries["embedding"].tolist(), np.float64)
    own, found = queries["vec_id"].to_numpy(), []
    margin = 1e-9 * max(1.0, float(np.abs(asked).sum(axis=1).max() * np.abs(different).max()))
    for at in range(0, len(asked), 256):
        scores = asked[at : at + 256] @ different.T
        keep = min(top + 1, scores.shape[1])
        least = np.partition(scores, -keep, axis=1)[:, -keep] - margin
        for k, query in enumerate(asked[at : at + 256]):
            near = np.flatnonzero(scores[k] >= least[k])
            score = exact_scores(query, different[near])
            mine = [ids[starts[n] : min(starts[n + 1], starts[n] + top + 1)] for n in near]
            vec = np.concatenate(mine)
            score = np.repeat(score, [len(m) for m in mine])
            other = vec != own[at + k]
            vec, score = vec[other], score[other]
            best = np.lexsort((vec, -score))[:top]
            found.append((own[at + k], vec[best], score[best]))
    return pd.DataFrame(
        {
            "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype("int64"),
            "vec_id": np.concatenate([f[1] for f in found]).astype("int64"),
            "score": np.concatenate([f[2] for f in found]),
        }
    )[columns]


def parts_for(rows: int, most: int = MOST_PARTS) -> int:
    """A power of two near two thirds of the square root of the rows, 8 at least."""
    return min(most, max(8, 1 << max(0, round(math.log2(max(rows, 1) ** 0.5 * 2 / 3)))))


def search(embeddings: DataFrame, is_query: str, top: int = 20, group_rows: int = GROUP_ROWS, sample_rows: int = SAMPLE_ROWS,
           wanted: float = WANTED_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found for each row that ``is_query``
    (a condition in SQL) holds for, itself left out; all others, if there are fewer.

    Rows that ``valid_vectors`` leaves out take no part. Ties go to the smaller vec_id. Ids are
    meant to be unique: rows with the same id are one vector (the first as an array). An empty table gives an empty
    result; other columns aren't read. Vectors are compared with those of their own length: the usual
    length by the index, of any other length all (a part for each length, whose number is below 0).
    """
    vectors = valid_vectors(embeddings).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = vectors.count()
    parts, length = parts_for(rows), usual_length(vectors)
    router = learn(vectors.where(F.size("embedding") == length), parts, top, sample_rows, wanted)
    shared = embeddings.sparkSession.sparkContext.broadcast(router)
    probes = router.probes

    def routed(count: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    sizes = frame["embedding"].map(len).to_numpy()
                    routes, usual = [[-int(n)] for n in sizes], np.flatnonzero(sizes == length)
                    if len(usual):
                        ranked = shared.value.rank(np.array(frame["embedding"].iloc[usual].tolist(), np.float64))[:, :count]
                        for at, own in zip(usual.tolist(), ranked.astype("int32").tolist()):
                            routes[at] = own
                    frame["parts"] = routes
                    yield frame[["vec_id", "embedding", "parts"]]

        return run

    schema = "vec_id long, embedding array<float>, parts array<int>"
    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = schema.replace("array<float>", kind)
    indexed = vectors.mapInPandas(routed(1), schema).withColumn("part", F.col("parts")[0])
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}  # one row a part
    salts = F.create_map(*(F.lit(x) for p, n in sorted(sizes.items()) for x in (p, -(-n // group_rows)))) if sizes else None
    salts = F.lit(1) if salts is None else F.coalesce(F.element_at(salts, F.col("part")), F.lit(0))
    indexed = indexed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.greatest(salts, F.lit(1))).cast("int"))
    asked = vectors.where(F.expr(is_query)).mapInPandas(routed(probes), schema).withColumn("part", F.explode("parts"))
    # A part's queries go to each of its groups; a part without rows has none.
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    groups = asked.groupBy("part", "salt").cogroup(indexed.groupBy("part", "salt"))
    near = groups.applyInPandas(lambda q, v: rank_group(q, v, top), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
