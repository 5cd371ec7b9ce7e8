"""Scores of an n-gram language model kept in Elias-Fano tries.

The model is an interpolated trigram model with absolute discounting over the base distribution of
single words. It is never in one place: each shard holds the trie of the triples whose middle word
is its own, which has all that their probabilities need but for the last word alone.

1. Each batch of whole texts sends its different triples, with their counts in training texts, to
   the shards of their middle words: packed, one row for each batch and shard.
2. A shard counts, builds its trie, and asks it for all triples it was sent. It answers each batch
   with two quantised figures a triple and the count of each middle word.
3. Each batch meets its answers and adds up its texts.

A very frequent middle word would make one shard large. Those words (a bounded list) are dealt out
by the word before them as well, so a shard has only some of their pairs with the next word. These
pairs go, counted in each batch, to pair shards of their own, which count them over all texts and
answer each batch too. The counts of frequent words, and of the different words behind each, are
summed over all shards. Where a word is counted so makes no difference to any score.

The batches must be the same in steps 1 and 3. A table read twice gives the same ones, also when a
task is run again; each batch is named by its place and content, and a batch without its answers is
an error, never a wrong figure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from promptloom.llm.eliasfano import Trie, probability, quantised
from promptloom.llm.words import WHITE, Words, mix, pack, slices, unpack
from promptloom.session import stored

#: Discount of every count, words that count as very frequent at most, share of a batch's tokens
#: from which a word may be one.
DISCOUNT, FREQUENT_MOST, FREQUENT_SHARE = 0.75, 4096, 0.001
#: Added to each count in the base distribution.
BASE_ADDED = 0.1
SHARDS_PER_PARTITION = 2
# Names of the start of a text, of what is before it, and of its end.
_START, _BEFORE, _END = (np.uint64(x) for x in (0x5354415254000001, 0x4245464F52450002, 0x454E440000000003))
_HALF, _LAST = np.uint64(32), np.uint64(0xFFFFFFFF)


class Tokens:
    """For each token of a batch (words and ends) the word before it and the one before that."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, WHITE, lower=True)
        hashes, rows = words.hashes(), len(texts)
        self.bounds = words.bounds + np.arange(rows + 1)
        total = len(hashes) + rows
        self.last = np.full(total, _END, np.uint64)
        self.last[np.arange(len(hashes)) + words.text_of()] = hashes
        starts = self.bounds[:-1]
        self.middle = np.concatenate([[_START], self.last[:-1]]).astype(np.uint64)[:total]
        self.middle[starts] = _START
        self.first = np.concatenate([[_BEFORE], self.middle[:-1]]).astype(np.uint64)[:total]
        self.first[starts] = _BEFORE
        self.counts = np.diff(self.bounds)


class Triples:
    """The different triples of a batch by (shard, middle, first and last), and which one each
    token is. First and last word are told apart by 32 bits of their hashes under a middle word."""

    def __init__(self, tokens: Tokens, frequent: np.ndarray, shards: int):
        middle = tokens.middle
        sides = (tokens.first >> _HALF) << _HALF | tokens.last >> _HALF
        route = np.where(np.isin(middle, frequent), mix(middle ^ mix(tokens.first)), middle)
        shard = ((route >> _HALF) * np.uint64(shards) >> _HALF).astype(np.int64)
        order = np.lexsort((sides, middle, shard))
        s, m, x = shard[order], middle[order], sides[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (m[1:] != m[:-1]) | (x[1:] != x[:-1])
        self.of_token = np.empty(len(s), np.int64)
        self.of_token[order] = np.cumsum(new) - 1
        self.shard, self.middle, self.sides = s[new], m[new], x[new]
        word = np.ones(len(self.shard), bool)
        word[1:] = (self.middle[1:] != self.middle[:-1]) | (self.shard[1:] != self.shard[:-1])
        self.word_starts = np.flatnonzero(word)
        self.edges = np.searchsorted(self.shard, np.arange(shards + 1))


class Pairs:
    """The different (frequent middle word, last word) among the triples of a batch by shard, and
    which one each of the triples ``at`` has. A name is the place of the middle word among the
    frequent ones (sorted) and 32 bits of the last word's hash."""

    def __init__(self, triples: Triples, frequent: np.ndarray, shards: int):
        place = np.minimum(np.searchsorted(frequent, triples.middle), len(frequent) - 1)
        self.at = np.flatnonzero(frequent[place] == triples.middle)
        names = place[self.at].astype(np.uint64) << _HALF | triples.sides[self.at] & _LAST
        names, which = np.unique(names, return_inverse=True)
        shard = ((mix(names) >> _HALF) * np.uint64(shards) >> _HALF).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.names, self.of_triple = names[order], rank[which]
        self.edges = np.searchsorted(shard[order], np.arange(shards + 1))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of bounded size with a name made of place and content."""
    partition = TaskContext.get().partitionId()
    for number, batch in enumerate(slices(batches)):
        digest = hashlib.blake2b(f"{partition}:{number}:".encode(), digest_size=8)
        for column in ("doc_id", "text"):
            for buffer in pa.concat_arrays([batch[column]]).buffers():
                if buffer is not None:
                    digest.update(buffer)
        yield int.from_bytes(digest.digest(), "little", signed=True), batch


def frequent_words(docs: DataFrame, most: int = FREQUENT_MOST, share: float = FREQUENT_SHARE) -> np.ndarray:
    """Hashes of words that are frequent in some batch, the most frequent first, at most ``most``;
    and the start of a text. They decide where triples are counted, not what is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, counts = np.unique(Words(batch["text"], WHITE, lower=True).hashes(), return_counts=True)
            kept = counts >= max(16, share * counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array(hashes[kept].view(np.int64)), pa.array(counts[kept])], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "word").limit(most).collect()
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    return np.unique(np.append(words, _START))


_ASKED = "chunk long, shard int, words binary, sizes binary, sides binary, counts binary"
_ANSWER = "chunk long, shard int, a binary, b binary, counts binary, tokens long, types long, frequent binary, frequent_counts binary, frequent_kinds binary"


def triples_of(docs: DataFrame, frequent, shards: int) -> DataFrame:
    """Packed triples of each batch for each shard, and its pairs for each pair shard (these have
    the numbers -1, -2, ...). ``docs``: doc_id, text, learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch in _named(batches):
            tokens = Tokens(batch["text"])
            triples = Triples(tokens, frequent.value, shards)
            learned = np.repeat(batch["learned"].to_numpy(zero_copy_only=False), tokens.counts)
            counts = np.bincount(triples.of_token[learned], minlength=len(triples.shard)).astype(np.uint32)
            sizes = np.diff(np.append(triples.word_starts, len(triples.shard))).astype(np.uint32)
            cut = np.searchsorted(triples.word_starts, triples.edges)
            columns: list[list] = [[] for _ in range(6)]
            for shard in np.flatnonzero(np.diff(triples.edges)).tolist():
                own, words = slice(triples.edges[shard], triples.edges[shard + 1]), slice(cut[shard], cut[shard + 1])
                row = (name, shard, pack(triples.middle[triples.word_starts[words]]), pack(sizes[words]), pack(triples.sides[own]), pack(counts[own]))
                for column, value in zip(columns, row):
                    column.append(value)
            pairs = Pairs(triples, frequent.value, shards)
            counts = np.bincount(pairs.of_triple, weights=counts[pairs.at], minlength=len(pairs.names)).astype(np.uint32)
            for shard in np.flatnonzero(np.diff(pairs.edges)).tolist():
                own = slice(pairs.edges[shard], pairs.edges[shard + 1])
                for column, value in zip(columns, (name, -1 - shard, b"", b"", pack(pairs.names[own]), pack(counts[own]))):
                    column.append(value)
            kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4
            names = ["chunk", "shard", "words", "sizes", "sides", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select("doc_id", "text", "learned").mapInArrow(run, _ASKED)


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["shard"] != row["shard"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def answer_shard(rows: list[dict], frequent: np.ndarray, discount: float) -> list[dict]:
    """Count the triples of a shard, build its trie and answer every batch (for frequent middle words
    without what the pair says); the first answer also has the shard's tokens and types, and its
    share of the counts of frequent words."""
    words = [unpack(r["words"], np.uint64) for r in rows]
    sizes = [unpack(r["sizes"], np.uint32) for r in rows]
    middle = np.concatenate([np.repeat(w, s) for w, s in zip(words, sizes)])
    sides = np.concatenate([unpack(r["sides"], np.uint64) for r in rows])
    counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    order = np.lexsort((sides, middle))
    m, x = middle[order], sides[order]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (x[1:] != x[:-1])
    heads = np.flatnonzero(new)
    totals = np.add.reduceat(counts[order], heads)
    m, x = m[heads], x[heads]
    seen = totals > 0
    trie = Trie(m[seen], (x[seen] >> _HALF).astype(np.int64), (x[seen] & _LAST).astype(np.int64), totals[seen], discount)
    a, b = trie.query(m, x >> _HALF, x & _LAST, np.isin(m, frequent))
    codes = np.stack([quantised(a), quantised(b)])
    of_row = np.empty(len(order), np.int64)
    of_row[order] = np.cumsum(new) - 1
    word_heads = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    word_counts = np.add.reduceat(totals, word_heads)
    own_words = m[word_heads]
    special = np.isin(own_words, frequent)
    plain = word_counts[~special]
    found, at = [], 0
    for row, own in zip(rows, words):
        size = len(row["sides"]) // 8
        which = of_row[at : at + size]
        at += size
        found.append(
            {
                "chunk": row["chunk"],
                "shard": row["shard"],
                "a": pack(codes[0][which]),
                "b": pack(codes[1][which]),
                "counts": pack(word_counts[np.searchsorted(own_words, own)]),
                "tokens": 0,
                "types": 0,
                "frequent": b"",
                "frequent_counts": b"",
                "frequent_kinds": b"",
            }
        )
    found[0] |= {
        "tokens": int(plain.sum()),
        "types": int((plain > 0).sum()),
        "frequent": own_words[special].tobytes(),
        "frequent_counts": word_counts[special].tobytes(),
        "frequent_kinds": bytes(8 * int(special.sum())),
    }
    return found


def answer_pairs(rows: list[dict], frequent: np.ndarray) -> list[dict]:
    """Count the pairs of a pair shard over all batches and answer each with the counts of its own;
    the first answer also has the different words that the shard knows behind each frequent word."""
    asked = [unpack(r["sides"], np.uint64) for r in rows]
    names, which = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows])
    totals = np.bincount(which, weights=counts, minlength=len(names)).astype(np.int64)
    found, at = [], 0
    empty = {"a": b"", "b": b"", "tokens": 0, "types": 0, "frequent": b"", "frequent_counts": b"", "frequent_kinds": b""}
    for row, own in zip(rows, asked):
        found.append({**empty, "chunk": row["chunk"], "shard": row["shard"], "counts": pack(totals[which[at : at + len(own)]])})
        at += len(own)
    places, kinds = np.unique((names[totals > 0] >> _HALF).astype(np.int64), return_counts=True)
    found[0] |= {
        "frequent": frequent[places].tobytes(),
        "frequent_counts": bytes(8 * len(places)),
        "frequent_kinds": kinds.astype(np.int64).tobytes(),
    }
    return found


def answers(triples: DataFrame, frequent, discount: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("chunk", pa.int64()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("counts", pa.binary())]
            + [("tokens", pa.int64()), ("types", pa.int64()), ("frequent", pa.binary()), ("frequent_counts", pa.binary())]
            + [("frequent_kinds", pa.binary())]
        )
        for rows in _shard_rows(batches):
            own = answer_pairs(rows, frequent.value) if rows[0]["shard"] < 0 else answer_shard(rows, frequent.value, discount)
            yield pa.RecordBatch.from_pylist(own, schema)

    partitions = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return triples.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(run, _ANSWER)


class Totals:
    """Tokens and types of the training texts, the counts of frequent words (sorted), and ``behind``:
    of each frequent word and the start its count and that of the different words behind it."""

    def __init__(self, tokens: int, types: int, words: np.ndarray, counts: np.ndarray, kinds: np.ndarray):
        start = words == _START
        self.behind = words, counts, kinds
        self.ends = int(counts[start].sum())
        self.words, self.counts = words[~start], counts[~start]
        self.tokens = tokens + int(self.counts.sum()) + self.ends
        self.types = types + int((self.counts > 0).sum()) + (self.ends > 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Probability of single tokens by their counts."""
        return (counts + BASE_ADDED) / (self.tokens + BASE_ADDED * (self.types + 1))

    def pair(self, middle: np.ndarray, counts: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) for pairs with a frequent middle word and their counts: the probability of the last
        word behind it is ``a + b * p`` with ``p`` that of the last word alone."""
        words, totals, kinds = self.behind
        a, b = np.zeros(len(middle)), np.ones(len(middle))
        if len(words):
            at = np.minimum(np.searchsorted(words, middle), len(words) - 1)
            known = (words[at] == middle) & (totals[at] > 0)
            at = at[known]
            a[known] = np.maximum(counts[known] - discount, 0) / totals[at]
            b[known] = discount * kinds[at] / totals[at]
        return a, b


def totals_of(answered: DataFrame) -> Totals:
    sums = answered.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[name], np.int64)) for name in names], ["word", "n", "kinds"])

    names = ["frequent", "frequent_counts", "frequent_kinds"]
    shares = answered.where("octet_length(frequent) > 0").select(*names).mapInArrow(run, "word long, n long, kinds long")
    rows = shares.groupBy("word").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()  # as many as there are frequent words
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    counts, kinds = (np.array([r[name] for r in rows], np.int64)[order] for name in ("n", "kinds"))
    return Totals(sums["n"] or 0, sums["v"] or 0, words[order], counts, kinds)


def _score_chunk(texts: pa.Table, answered: pa.Table, frequent: np.ndarray, totals: Totals, shards: int, discount: float) -> pa.Table:
    texts = texts.sort_by("place").combine_chunks()
    tokens = Tokens(texts["text"].combine_chunks())
    triples = Triples(tokens, frequent, shards)
    rows = answered.sort_by("shard").to_pylist()
    paired, rows = [r for r in reversed(rows) if r["shard"] < 0], [r for r in rows if r["shard"] >= 0]
    a, b, counts = (
        np.concatenate([np.zeros(0, kind), *(unpack(r[name], kind) for r in rows)])
        for name, kind in (("a", np.uint16), ("b", np.uint16), ("counts", np.int64))
    )
    pairs = Pairs(triples, frequent, shards)
    pair_counts = np.concatenate([np.zeros(0, np.int64), *(unpack(r["counts"], np.int64) for r in paired)])
    if len(a) != len(triples.shard) or len(counts) != len(triples.word_starts) or len(pair_counts) != len(pairs.names):
        raise RuntimeError("the rows changed between two reads; store them first")
    words = triples.middle[triples.word_starts]
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    word_of = np.searchsorted(words, tokens.last)
    own = counts[np.minimum(word_of, len(words) - 1)]
    own = np.where(tokens.last == _END, totals.ends, own)
    if len(totals.words):  # their counts are shared among shards
        at = np.minimum(np.searchsorted(totals.words, tokens.last), len(totals.words) - 1)
        own = np.where(totals.words[at] == tokens.last, totals.counts[at], own)
    single = totals.base(own)
    a, b = probability(a), probability(b)
    pair_a, pair_b = totals.pair(frequent[(pairs.names >> _HALF).astype(np.int64)], pair_counts, discount)
    a[pairs.at] += b[pairs.at] * pair_a[pairs.of_triple]
    b[pairs.at] *= pair_b[pairs.of_triple]
    p = a[triples.of_token] + b[triples.of_token] * single
    starts = tokens.bounds[:-1]
    return pa.table(
        {
            "doc_id": texts["doc_id"],
            "held_out": texts["held_out"],
            "n_tokens": pa.array(tokens.counts, pa.int64()),
            "n_known": pa.array(np.add.reduceat(own > 0, starts, dtype=np.int64), pa.int64()),
            "train_tokens": pa.array(np.full(len(starts), totals.tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(single), starts)),
            "score": pa.array(np.add.reduceat(np.log10(p), starts)),
        }
    )


def score_documents(docs: DataFrame, held_out: str, discount: float = DISCOUNT, frequent_most: int = FREQUENT_MOST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows that ``held_out`` (a condition in SQL) isn't true for; null counts as not true.
    Tokens are the lower-cased words and one end. Null and empty texts are an end alone. Repeated
    rows count each; other columns aren't read; an empty table gives an empty one. ``score`` is the
    model's log10 probability, from 16-bit quantised parts; ``base_score`` that of single tokens.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    shards = SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = spark.sparkContext.broadcast(frequent_words(own, frequent_most))
    asked = triples_of(own.select("doc_id", "text", (~F.col("held_out")).alias("learned")), frequent, shards)
    answered = stored(answers(asked, frequent, discount))
    totals = spark.sparkContext.broadcast(totals_of(answered))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch in _named(batches):
            columns = [pa.array(np.full(batch.num_rows, name)), pa.array(np.arange(batch.num_rows)), batch["doc_id"], batch["text"], batch["held_out"]]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "place", "doc_id", "text", "held_out"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = own.mapInArrow(named, "chunk long, place long, doc_id long, text string, held_out boolean")
    parts = answered.select("chunk", "shard", "a", "b", "counts")
    together = texts.groupBy("chunk").cogroup(parts.groupBy("chunk"))
    return together.applyInArrow(lambda t, p: _score_chunk(t, p, frequent.value, totals.value, shards, discount), schema)
