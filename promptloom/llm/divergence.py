"""How the word use of sources differs, within each language.

Counts come from one pass over the texts, added up in each batch, each task and then by (lang, source,
term); a term's rows meet once more to be kept or dropped by its documents. The kept terms of a
language are dealt out to blocks of about ``BLOCK_TERMS``. A block is a subtree over the ids of its
terms: every source has a segment tree of its counts there, and equal subtrees, of one source or of
many, are one node (hash-consing, level by level). Two sources are compared by walking their trees at
the same time; a pair of nodes that was met before is not walked again but counted once more, so its
price is worked out once. Prices of blocks add up by pair of sources in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from promptloom.llm.words import Words, slices
from promptloom.session import stored

#: A term is kept if at least so many documents of its language hold it.
LEAST_DOCUMENTS = 30
#: Terms that the ``term`` part gives for each group.
TOP_TERMS = 50
#: Added to every count, so that no share is nothing.
SMOOTHING = 5
#: Shares are whole numbers of this.
UNIT = 10**9
#: Terms of a block, and sources that meet in a task with as many others, on average.
BLOCK_TERMS, CHUNK_SOURCES = 1024, 64
#: Pairs of nodes that a task walks at once, at most (one pair of sources at least).
WALKED = 1 << 20

#: Bytes that are no letter: words are ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
_APART = np.zeros(256, bool)
_APART[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each batch: occurrences, and texts that hold the term."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in slices(batches):
        words = Words(batch["text"], _APART, lower=True)
        if not len(words):
            continue
        spelled = words.array().dictionary_encode()
        which, size = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(spelled.dictionary)
        langs, sources = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
        group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary)
        group += sources.indices.to_numpy(zero_copy_only=False)
        text = words.text_of()
        pairs, n = np.unique(group[text] * size + which, return_counts=True)
        held = np.unique(text * size + which)
        _, docs = np.unique(group[held // size] * size + held % size, return_counts=True)
        own = pairs // size
        columns = [
            langs.dictionary.take(pa.array(own // len(sources.dictionary))),
            sources.dictionary.take(pa.array(own % len(sources.dictionary))),
            spelled.dictionary.take(pa.array(pairs % size)).cast(pa.binary()).cast(pa.string()),
            pa.array(n.astype(np.int64)),
            pa.array(docs.astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


def _named(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", *more)))


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total, first): occurrences of the kept terms in each group and in the
    language; ``first`` marks one row of each (lang, term)."""
    rows = _named(docs, "text").mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    meet = Window.partitionBy("lang", "term")  # at most one row for each source
    rated = counts.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(meet).alias("lang_docs"),
        F.sum("n").over(meet).alias("total"),
        (F.col("source") == F.min("source").over(meet)).alias("first"),
    )
    return rated.where(F.col("lang_docs") >= least).drop("lang_docs")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, terms, sources): all groups, those without kept terms too."""
    groups = _named(docs).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("long")).alias("firsts"))
    sized = groups.join(own, ["lang", "source"], "left")
    nothing = F.lit(0).cast("long")
    langs = sized.groupBy("lang").agg(
        F.coalesce(F.sum("size"), nothing).alias("lang_size"), F.coalesce(F.sum("firsts"), nothing).alias("terms"), F.count("*").alias("sources")
    )
    return sized.join(langs, "lang").select("lang", "source", F.coalesce("size", nothing).alias("size"), "lang_size", "terms", "sources")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / whole), exactly, by long division three digits at a time;
    ``whole`` is at least ``count + SMOOTHING`` and below 2 ** 53."""
    rest, found = counts + SMOOTHING, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return 1 + found


class Forest:
    """Segment trees of several rows of counts over the same ids, equal subtrees shared.

    ``leaves``: the count of each leaf node, -1 beyond the last id. ``halves[k]``: the two nodes below
    each node of level k + 1. ``roots``: the root of each row.
    """

    def __init__(self, counts: np.ndarray):
        rows, ids = counts.shape
        width = 1 << max(ids - 1, 0).bit_length()
        padded = np.full((rows, width), -1, np.int64)
        padded[:, :ids] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes, self.halves = nodes.reshape(rows, width), []
        while nodes.shape[1] > 1:
            most = int(nodes.max()) + 1
            pairs, nodes = np.unique(nodes[:, 0::2] * most + nodes[:, 1::2], return_inverse=True)
            nodes = nodes.reshape(rows, -1)
            self.halves.append((pairs // most, pairs % most))
            width //= 2
        self.roots = nodes[:, 0]

    def distances(self, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, int]:
        """Sums over all ids of the differences of shares of rows a[i] and b[i], and how many pairs of
        leaves were priced. ``whole``: what the shares of each row are shares of."""
        pair, left, right = np.arange(len(a)), self.roots[a], self.roots[b]
        times = np.ones(len(a), np.int64)
        for one, other in reversed(self.halves):
            pair, times = np.tile(pair, 2), np.tile(times, 2)
            left, right = np.concatenate([one[left], other[left]]), np.concatenate([one[right], other[right]])
            pair, left, right, times = _once(pair, left, right, times)
        x, y = self.leaves[left], self.leaves[right]
        real = x >= 0  # all rows end at the same id
        pair, x, y, times = pair[real], x[real], y[real], times[real]
        price = np.abs(shares(x, whole[a[pair]]) - shares(y, whole[b[pair]]))
        sums = np.zeros(len(a), np.int64)
        np.add.at(sums, pair, price * times)
        return sums, len(pair)


def _once(pair, left, right, times):
    """Every different (pair, left, right) once, ``times`` added up."""
    m, n = int(left.max(initial=0)) + 1, int(right.max(initial=0)) + 1
    codes, at = np.unique((pair * m + left) * n + right, return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, at, times)
    return codes // (m * n), codes // n % m, codes % n, total


def compare(rows: pa.Table, groups: pa.Table, same: bool) -> pa.Table:
    """(lang, source, item, value) of all pairs of sources that meet in a block, both ways round.
    ``groups``: source, chunk, whole, block_terms; ``rows``: source, term, n. ``same``: both come from
    one chunk. Terms of the block that no source here has count 0 in all."""
    groups = groups.sort_by("source")
    names = groups["source"].combine_chunks()
    whole, chunk = (groups[c].to_numpy().astype(np.int64) for c in ("whole", "chunk"))
    terms = rows["term"].combine_chunks().dictionary_encode()
    which, n = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows["n"].to_numpy().astype(np.int64)
    own = pa.compute.index_in(rows["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.zeros(len(terms.dictionary), np.int64)
    np.add.at(total, which, n)
    place = np.empty(len(total), np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(total))  # like counts beside each other
    width = int(groups["block_terms"][0].as_py()) if len(names) else 0
    counts = np.zeros((len(names), width), np.int64)
    counts[own, place[which]] = n
    a, b = np.triu_indices(len(names), 1)
    if not same:
        across = chunk[a] != chunk[b]
        a, b = a[across], b[across]
    value = np.zeros(len(a), np.int64)
    if width:
        forest, step = Forest(counts), max(WALKED // width, 1)
        for at in range(0, len(a), step):
            value[at : at + step], _ = forest.distances(a[at : at + step], b[at : at + step], whole)
    ends = names.take(pa.array(np.concatenate([a, b]))), names.take(pa.array(np.concatenate([b, a])))
    return pa.table({"source": ends[0], "item": ends[1], "value": np.concatenate([value, value])})


def pair_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language, both ways round.

    A task holds the counts of one block for two chunks of sources: about ``BLOCK_TERMS`` times twice
    ``CHUNK_SOURCES`` figures, whatever the size of the language.
    """
    chunks = F.ceil(F.col("sources") / CHUNK_SOURCES)
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1))
    dealt = groups.select(
        "lang", "source", F.pmod(F.xxhash64("source"), chunks).alias("chunk"), chunks.alias("chunks"), blocks.alias("blocks"),
        (F.col("size") + SMOOTHING * F.col("terms")).alias("whole"),
    )
    with_block = kept.select("lang", "source", "term", "n", "first").join(dealt.drop("whole"), ["lang", "source"])
    with_block = with_block.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    sizes = with_block.where("first").groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    everywhere = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    everywhere = everywhere.join(sizes, ["lang", "block"], "left").fillna(0, ["block_terms"])

    def meeting(df: DataFrame, *columns: str) -> DataFrame:
        other = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        return other.select("lang", "block", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), *columns)

    key = ["lang", "block", "lo", "hi"]
    left = meeting(with_block, "source", "term", "n").groupBy(*key)
    right = meeting(everywhere, "source", "chunk", "whole", "block_terms").groupBy(*key)

    def together(key: tuple, rows: pa.Table, sources: pa.Table) -> pa.Table:
        found = compare(rows, sources, key[2].as_py() == key[3].as_py())
        lang = pa.array([key[0].as_py()] * found.num_rows, pa.string())
        return pa.table([lang, found["source"], found["item"], found["value"]], names=["lang", "source", "item", "value"])

    parts = left.cogroup(right).applyInArrow(together, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_lifts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has a larger share of than its language."""

    def share(count: str, size: str):
        return f"cast({UNIT} as decimal(10,0)) * cast({count} + {SMOOTHING} as decimal(20,0)) div cast({size} + {SMOOTHING} * terms as decimal(20,0))"

    rated = kept.drop("first").join(groups.select("lang", "source", "size", "lang_size", "terms"), ["lang", "source"])
    value = F.expr(f"({share('n', 'size')}) - ({share('total', 'lang_size')})")
    return rated.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group (lang, source) is from each other
    source of its language (``pair``), and its most over-represented terms (``term``).

    A null text, lang or source is ''; every row is a document, repeated rows and ids too. Groups
    without terms are compared as well; where a language keeps no term all distances are 0. A source
    alone in its language has no ``pair`` row. Only lang, source and text are read.
    """
    kept = stored(kept_counts(docs, least))
    groups = stored(group_sizes(docs, kept))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_distances(kept, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked))
    terms = term_lifts(kept, groups).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(ranked))
    return pairs.select(columns).unionByName(terms.where(F.col("rank") <= top).select(columns))
