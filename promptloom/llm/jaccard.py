"""N-gram Jaccard join by vertical partitioning.

All shingles stand in one global order, that of their hashes, and the order is cut into fragments.
Two sets of a size class that are as similar as asked differ in at most ``d`` shingles, so if the
order is cut into ``F > d`` fragments, ``F - d`` of the fragments hold the same shingles of both. One
shuffle of fragment names finds the sets that share a fragment; connected by these they make blocks,
and only within a block sets can link.

A fragment's name says much if it holds two shingles or more, so smaller ones are named only by a
set where ``F - d`` or more are small: else one of the equal ones is not. Shingles that stand in many
sets say nothing; they are left out of the fragments (a set with too little left names fragments of
all its shingles as well). Which shingles count as frequent changes the work, never the result.

Sets that share a name are pairs to be counted. The overlap of a pair is counted in each fragment of
the order on its own, by (pair, fragment) in separate tasks, and summed by pair; no task sees a whole
group. Only pairs that can link by their parities are counted: 512 bits of each set, of which two sets
differ in no more than in shingles, and for larger sets a sketch of two to four such bits for each shingle,
compared for the pairs that the 512 leave. Only what is left is counted, and only the texts in these
pairs are cut into shingles once more. First every document is counted with the hub (the first holder of a
name) that it shares most names with. What is linked so is one component; it is counted with its other
hubs and with a drawn holder of each of its names, and under names whose holders are not yet in one
component with all holders of other components that the parities leave. So a group of near copies costs
its size in counting, not its square, as far as its members link with these; elsewhere the parities of all
its pairs are compared, whatever their number, so no link between components is left out.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from promptloom.llm import keys
from promptloom.llm.components import components
from promptloom.llm.words import HALF_BATCH_BYTES, WHITE, Words, mix, pack, sequence_hashes, slices, unpack
from promptloom.session import discard, stored

#: Words of a shingle, and the similarity that links, in hundredths.
SHINGLE, SIMILARITY = 4, 85
#: Shingles that are kept out of fragments: those in this share of a batch's sets or more, at most
#: so many of them (8 bytes each are broadcast).
FREQUENT_SHARE, FREQUENT_MOST = 0.004, 50_000
#: Fragments in which overlaps are counted: 2 ** 2 ranges of the global order.
FRAGMENT_BITS = 2
#: Documents that stand for others, with these (16 bytes a row), that are broadcast; more are joined.
BROADCAST_MOVED = 500_000
#: Pairs of one node that are counted under one key, on average.
HUB_PAIRS = 256
#: Other holders of its names that a document is counted with before all that are in other components.
ASKED = 8
#: Longs that hold the parities of a set, 64 bits each.
PARITIES = [f"p{k}" for k in range(8)]
#: Bits of a sketch for each shingle of the set, at least; it has a power of two of them.
SKETCH_BITS = 2
#: Bytes of sketches that are compared at once.
SKETCH_BYTES = 4 << 20
#: Bits for each document of a map of those that are looked for, about, and bits of a row of the map; its
#: rows at most (4 KB each are broadcast).
MAP_BITS, MAP_ROW, MAP_ROWS = 8, 1 << 15, 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class ShingleSets:
    """The different shingles of each text of a batch: sorted hashes, ``bounds`` for each text."""

    def __init__(self, texts: pa.Array, size: int = SHINGLE):
        words = Words(texts, WHITE, lower=True)
        own = words.hashes()
        text = words.text_of()
        hashes = sequence_hashes(own, size)
        at = np.flatnonzero(text[: len(hashes)] == text[size - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        hashes, owner = hashes[at], text[at]
        for few in range(1, size):  # a text of fewer words is one shingle
            short = words.bounds[:-1][words.counts == few]
            if len(short):
                hashes = np.concatenate([hashes, sequence_hashes(own, few)[short]])
                owner = np.concatenate([owner, text[short]])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[new], owner[new]
        self.bounds = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.sizes = np.diff(self.bounds)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each whole set, as two columns; 0 for an empty one."""
        found = []
        for salt in (1, 2):
            sums = np.zeros(len(self.sizes), np.uint64)
            some = np.flatnonzero(self.sizes)
            if len(some):
                sums[some] = np.add.reduceat(mix(self.hashes * np.uint64(2 * salt + 1) + np.uint64(salt)), self.bounds[some])
            found.append(sums.view(np.int64))
        return found[0], found[1]

    def parities(self) -> np.ndarray:
        """A row of longs for each text. Each shingle falls on one of their bits, which is 1 if an odd
        number has. Bits that tell two sets apart are so at most as many as shingles that do."""
        bits = 64 * len(PARITIES)
        found = np.zeros((len(self.sizes), len(PARITIES)), np.int64)
        for at in range(0, len(self.sizes), 2048):
            some = slice(self.bounds[at], self.bounds[min(at + 2048, len(self.sizes))])
            cell = (self.owner[some] - at) * bits + (self.hashes[some] & np.uint64(bits - 1)).astype(np.int64)
            rows = len(found[at : at + 2048])
            odd = (np.bincount(cell, minlength=rows * bits) & 1).astype(np.uint8)
            found[at : at + 2048] = np.packbits(odd).view(np.int64).reshape(rows, -1)
        return found

    def sketches(self) -> pa.Array:
        """The same with more bits, for each text whose set is large enough to need them; empty for the others.
        Half of the bits laid over the other half, by exclusive or, are the sketch of half as many."""
        bits = np.left_shift(1, np.ceil(np.log2(np.maximum(SKETCH_BITS * self.sizes, 1))).astype(np.int64))
        bits[bits <= 64 * len(PARITIES)] = 0
        ends = np.cumsum(bits)
        some = bits[self.owner] > 0
        own = self.owner[some]
        cell = (ends - bits)[own] + (self.hashes[some] & (bits[own] - 1).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(cell, minlength=int(bits.sum())) & 1).astype(np.uint8)
        offsets = (np.append(0, ends) // 8).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd).tobytes())])


def size_classes(most: int) -> np.ndarray:
    """First size of each class; a set and one as similar as asked lie in one class or in two
    classes side by side."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 5 // 4)))
    return np.array(starts, np.int64)


def differing(largest: np.ndarray, similarity: int) -> np.ndarray:
    """Shingles that two linked sets of at most ``largest`` shingles have but don't share, at most."""
    return (100 - similarity) * 2 * largest // (100 + similarity)


def _fragment_names(owner, hashes, fragments):
    """For sorted (owner, hash) pairs and the number of fragments of each owner: (owner, fragment,
    name, shingles) of each fragment that isn't empty."""
    if not len(hashes):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, np.zeros(0, np.uint64), nothing
    part = ((hashes >> np.uint64(32)) * fragments[owner].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(hashes), bool)
    new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    sums = np.add.reduceat(mix(hashes), heads)
    sizes = np.diff(np.append(heads, len(hashes)))
    return owner[heads], part[heads].astype(np.int64), sums, sizes


def fragment_keys(sets: ShingleSets, wanted: np.ndarray, frequent: np.ndarray, similarity: int):
    """(key, text) pairs under which the wanted texts look for sets like theirs."""
    starts = size_classes(int(sets.sizes.max(initial=1)) * 2 + 2)
    own = np.searchsorted(starts, sets.sizes, "right") - 1
    found_keys, found_rows = [], []
    rare = ~np.isin(sets.hashes, frequent) if len(frequent) else np.ones(len(sets.hashes), bool)
    for up in (0, 1):  # each set looks in its class, and in the next one if a linked set can be there
        group = own + up
        lowest = np.maximum(starts[group], 1)
        largest = starts[group + 1] - 1
        d = differing(largest, similarity)
        asks = wanted & (sets.sizes > 0) & (d > 0)
        if up:
            asks &= 100 * sets.sizes >= similarity * lowest
        fragments = d + 2 + d // 2
        # Rare shingles; all shingles; all, with fragments of one shingle too; the empty fragments.
        for scheme in (0, 1, 2, 3):
            if not asks.any():
                break
            use = asks[sets.owner] & (rare if scheme == 0 else True)
            owner, part, name, size = _fragment_names(sets.owner[use], sets.hashes[use], fragments)
            if scheme < 2:
                big = size >= 2
                many = np.bincount(owner[big], minlength=len(sets.sizes))
                owner, part, name, size = owner[big], part[big], name[big], size[big]
            elif scheme == 2:
                many = np.bincount(owner, minlength=len(sets.sizes))
            else:
                rows = np.flatnonzero(asks)
                total = fragments[rows]
                cell = np.repeat(np.cumsum(total) - total, total)
                place = np.arange(int(total.sum())) - cell
                whole_owner = np.repeat(rows, total)
                shift = np.zeros(len(sets.sizes), np.int64)
                shift[rows] = np.cumsum(total) - total
                whole = np.zeros(len(place), np.uint64)
                whole[shift[owner] + part] = name
                owner, part, name = whole_owner, place, whole
                many = fragments
            salted = mix(name + mix((group[owner] * 4 + scheme).astype(np.uint64) * _GOLD + part.astype(np.uint64)))
            found_keys.append(salted)
            found_rows.append(owner)
            asks = asks & (fragments - many >= fragments - d)  # as many are small as may be all that is equal
    if not found_keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found_keys), np.concatenate(found_rows)


def describe(docs: DataFrame, size: int = SHINGLE, frequent_share: float = FREQUENT_SHARE) -> DataFrame:
    """(doc_id, n_shingles, name_a, name_b, frequent, parities, sketch): the set of each document in brief. The
    first row of a batch has the shingles, packed, that are frequent in it; the others have null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HALF_BATCH_BYTES):
            sets = ShingleSets(batch["text"], size)
            a, b = sets.names()
            _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
            once = np.zeros(len(a), bool)
            once[first] = True  # each different set counts once
            shingles, many = np.unique(sets.hashes[once[sets.owner]], return_counts=True)
            frequent = shingles[many >= max(8, frequent_share * len(first))]
            blobs = [pack(frequent) if len(frequent) else None] + [None] * (batch.num_rows - 1)
            columns = [batch["doc_id"], pa.array(sets.sizes, pa.int64()), pa.array(a), pa.array(b), pa.array(blobs, pa.binary())]
            columns += [*(pa.array(p) for p in sets.parities().T.copy()), sets.sketches()]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "name_a", "name_b", "frequent", *PARITIES, "sketch"])

    schema = f"doc_id long, n_shingles long, name_a long, name_b long, frequent binary, {', '.join(f'{p} long' for p in PARITIES)}, sketch binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def frequent_shingles(described: DataFrame, most: int = FREQUENT_MOST) -> np.ndarray:
    """Shingles frequent in some batch, those of the most batches first (of equal ones the smallest
    hash), at most ``most`` of them. Any choice gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["frequent"]:
                yield pa.RecordBatch.from_arrays([pa.array(unpack(blob.as_py(), np.int64))], ["shingle"])

    single = described.where("frequent IS NOT NULL").select("frequent").mapInArrow(run, "shingle long")
    rows = single.groupBy("shingle").count().orderBy(F.desc("count"), "shingle").limit(most).select("shingle")
    return np.sort(np.array([r[0] for r in rows.collect()], np.int64).view(np.uint64))


def shared_fragments(docs: DataFrame, frequent: np.ndarray, size: int, similarity: int) -> DataFrame:
    """(key, owner, hub): documents that look for sets like theirs under the same name; all that hold
    a name are tied to its smallest holder by their hubs."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def keys_of(batch: pa.RecordBatch):
        sets = ShingleSets(batch["text"], size)
        a, b = sets.names()
        _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
        wanted = np.zeros(len(a), bool)
        wanted[first] = True  # equal sets of a batch ask once
        return _by_row(*fragment_keys(sets, wanted, known.value, similarity))

    return keys.shared(keys.pairs(docs, "doc_id", keys_of, HALF_BATCH_BYTES))


def _by_row(found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    return found[order], rows[order]


def among(docs: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is a ``node``, and a few others: the nodes are marked in a map of
    bits that is broadcast, so the texts stay where they are. ``many``: how many documents there are, about."""
    rows = min(max(1, -(-MAP_BITS * many // MAP_ROW)), MAP_ROWS)
    place, row = (lambda column, k=k, n=n: F.pmod(F.xxhash64(column, F.lit(k)), F.lit(n)) for k, n in ((1, MAP_ROW), (2, rows)))
    marks = nodes.select(row("node").alias("map_row"), place("node").alias("place")).repartition("map_row")
    marks = marks.groupBy("map_row").agg(F.bitmap_construct_agg("place").alias("map"))
    placed = docs.withColumns({"own_row": row("doc_id"), "place": place("doc_id")})
    found = placed.join(F.broadcast(marks), F.col("own_row") == F.col("map_row"))
    byte = F.expr("cast(conv(hex(substring(map, cast(place div 8 as int) + 1, 1)), 16, 10) as int)")
    return found.where(F.getbit(byte, F.expr("cast(place % 8 as int)")) == 1).select(*docs.columns)


_SEGMENT = "node long, name long, n long, fragment int, hashes binary"


def segments(texts: DataFrame, size: int) -> DataFrame:
    """(node, name, n, fragment, hashes): the sets of documents cut by ranges of the global order, one row
    for each fragment that isn't empty; ``name`` tells the sets of a node apart, ``n`` is the size of the
    whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HALF_BATCH_BYTES):
            sets = ShingleSets(batch["text"], size)
            part = (sets.hashes >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int64)
            cell = sets.owner * (1 << FRAGMENT_BITS) + part  # rises, as hashes of a set do
            heads = np.flatnonzero(np.diff(cell, prepend=-1))
            offsets = (np.append(heads, len(cell)) * 8).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(sets.hashes.tobytes())])
            own = sets.owner[heads]
            columns = [batch["node"].take(pa.array(own)), pa.array(sets.names()[0][own]), pa.array(sets.sizes[own], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(part[heads], pa.int32()), blobs], ["node", "name", "n", "fragment", "hashes"])

    return texts.select("node", "text").mapInArrow(run, _SEGMENT)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets of each value in them) of a binary array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def _differing_bits(a: pa.Array, b: pa.Array) -> np.ndarray:
    """For each row in how many bits the sketches differ, the larger one laid over to the size of the smaller;
    0 if one is empty."""
    found = np.zeros(len(a), np.int64)
    (x, from_x), (y, from_y) = _bytes(a), _bytes(b)
    sizes = np.stack([np.diff(from_x), np.diff(from_y)], axis=1)
    for p, q in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes[:, 0] == p) & (sizes[:, 1] == q)) if p and q else []
        step = max(1, SKETCH_BYTES // max(p, q, 1))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            sides = [np.stack([data[lo : lo + n] for lo in starts[some]]) for data, starts, n in ((x, from_x, p), (y, from_y, q))]
            for k in (0, 1):
                while sides[k].shape[1] > min(p, q):
                    half = sides[k].shape[1] // 2
                    sides[k] = sides[k][:, :half] ^ sides[k][:, half:]
            found[some] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
    return found


def _common(a: pa.Array, b: pa.Array) -> np.ndarray:
    """For each row how many hashes both hold; both sorted."""
    flat, rows = [], []
    for column in (a, b):
        data, offsets = _bytes(column)
        flat.append(data.view(np.uint64))
        rows.append(np.repeat(np.arange(len(column)), np.diff(offsets) // 8))
    # Rows follow each other and hashes rise in each, so this order rises over all of them.
    ranks = [row.astype(np.uint64) << np.uint64(44) | hashes << np.uint64(FRAGMENT_BITS) >> np.uint64(20) for row, hashes in zip(rows, flat)]
    found, at = np.zeros(len(a), np.int64), np.searchsorted(ranks[1], ranks[0])
    open_ = np.arange(len(at))
    while len(open_):  # equal ranks are rare unless the hashes are equal
        open_ = open_[at[open_] < len(ranks[1])]
        open_ = open_[ranks[1][at[open_]] == ranks[0][open_]]
        equal = flat[1][at[open_]] == flat[0][open_]
        np.add.at(found, rows[0][open_[equal]], 1)
        open_ = open_[~equal]
        at[open_] += 1
    return found


def _may_link(x: str, y: str, similarity: int):
    """Whether sets of two rows can be as similar as asked, by their sizes and parities: a condition
    that every linked pair meets."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = reduce(operator.add, [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITIES])
    sizes = (100 * n >= similarity * m) & (100 * m >= similarity * n)
    return sizes & ((100 + similarity) * differ <= (100 - similarity) * (n + m))


def outlines(described: DataFrame) -> DataFrame:
    """(node, n, parities, sketch): one row for each set."""
    some = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    return some.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), *PARITIES, "sketch")


def _ends(pairs: DataFrame, sets: DataFrame, hub_pairs: int, *also: str) -> DataFrame:
    """(a, b) of ``pairs`` with the rows of ``sets`` of both ends, as ``own`` and ``other``, that agree in
    ``also``. The rows of a node in very many pairs go to several keys, each with a bounded number of its
    pairs."""
    times = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / hub_pairs).alias("salts"))
    dealt = pairs.join(times, F.col("b") == F.col("hub")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt_of")
    theirs = times.join(sets, F.col("hub") == F.col("node")).select(sets["*"], salts).alias("other")
    mine = dealt.join(sets.alias("own"), F.col("a") == F.col("own.node"))
    meet = (F.col("b") == F.col("other.node")) & (F.col("salt") == F.col("other.salt_of"))
    for column in also:
        meet &= F.col(f"own.{column}") == F.col(f"other.{column}")
    return mine.join(theirs, meet)


def likely(pairs: DataFrame, sets: DataFrame, similarity: int, hub_pairs: int = HUB_PAIRS) -> DataFrame:
    """The (a, b) of ``pairs`` that can link by the parities of their ``outlines``; only these are worth counting."""
    near = _ends(pairs, sets.drop("sketch"), hub_pairs).where(_may_link("own", "other", similarity))
    return sifted(stored(near.select("a", "b").distinct()), sets, similarity, hub_pairs)


def sifted(pairs: DataFrame, sets: DataFrame, similarity: int, hub_pairs: int = HUB_PAIRS) -> DataFrame:
    """The (a, b) of ``pairs`` that can link by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch[c].to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            kept = (100 + similarity) * _differing_bits(batch["own"], batch["other"]) <= (100 - similarity) * (n + m)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    both = _ends(pairs, sets.select("node", "n", "sketch"), hub_pairs).select(
        "a", F.col("own.n").alias("n_a"), "b", F.col("other.n").alias("n_b"), F.col("own.sketch").alias("own"), F.col("other.sketch").alias("other"),
    )
    return both.mapInArrow(run, "a long, b long").distinct()


def linked(pairs: DataFrame, sets: DataFrame, similarity: int, hub_pairs: int = HUB_PAIRS) -> DataFrame:
    """The (a, b) of ``pairs`` that link. The overlap of two sets is counted fragment by fragment, by
    (pair, fragment) in separate tasks, and summed by pair."""
    names = ["a", "x", "n_a", "b", "y", "n_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(at, 1 << 16)
                both = pa.array(_common(part["own"], part["other"]))
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), part["fragment"], both], [*names, "fragment", "both"])

    near = _ends(pairs, sets, hub_pairs, "fragment").select(
        "a", F.col("own.name").alias("x"), F.col("own.n").alias("n_a"), "b", F.col("other.name").alias("y"),
        F.col("other.n").alias("n_b"), F.col("own.fragment").alias("fragment"), F.col("own.hashes").alias("own"),
        F.col("other.hashes").alias("other"),
    )
    # As similar as asked they differ little in size.
    near = near.where((100 * F.col("n_a") >= similarity * F.col("n_b")) & (100 * F.col("n_b") >= similarity * F.col("n_a")))
    counted = near.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", fragment int, both long")
    counted = counted.dropDuplicates([*names, "fragment"])  # a row that comes twice counts once
    sums = counted.groupBy(*names).agg(F.sum("both").alias("both"))
    return sums.where(100 * F.col("both") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b").distinct()


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    for end in ("a", "b"):
        own = joined.select(F.col("node").alias(f"node_{end}"), F.col("component").alias(f"component_{end}"))
        pairs = pairs.join(own, F.col(end) == F.col(f"node_{end}"), "left")
    ends = [F.coalesce(f"component_{end}", end) for end in ("a", "b")]
    return pairs.where(ends[0] != ends[1]).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    similarity: int = SIMILARITY,
    hub_pairs: int = HUB_PAIRS,
    frequent_share: float = FREQUENT_SHARE,
    frequent_most: int = FREQUENT_MOST,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Sets link if 100 * |x & y| >= similarity * |x | y|. Equal sets are one class from the start. Null
    and empty texts have no shingles and link with nothing, repeated rows of one doc_id included: each is its
    own component. Rows without doc_id take no part and have a null component. A doc_id with several
    texts connects what any of them is linked to. Ties don't arise: the component is named after
    its smallest doc_id. Other columns aren't read; an empty table gives an empty one.
    """
    if not 80 <= similarity <= 100:  # the size classes are a quarter apart
        raise ValueError("similarity must be 80 to 100 hundredths")
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    described = stored(describe(docs.select("doc_id", "text"), size, frequent_share))
    documents = described.count()
    frequent = frequent_shingles(described, frequent_most)
    own = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(own.groupBy("name_a", "name_b", "n_shingles").agg(F.min("doc_id").alias("first")))
    names = [F.col(f"own.{n}") == F.col(f"class.{n}") for n in ("name_a", "name_b", "n_shingles")]
    member = own.alias("own").join(classes.alias("class"), names).select("own.doc_id", "class.first")
    equal = member.where("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()

    # Documents stand for the first of their equals; one with several texts for all it is equal to.
    others = member.where("doc_id != first").select("doc_id").distinct()
    moved = stored(member.join(others, "doc_id", "left_semi").distinct().select(F.col("doc_id").alias("moved"), "first"))
    if moved.count() <= BROADCAST_MOVED:
        moved = F.broadcast(moved)
    named = shared_fragments(texts, frequent, size, similarity)
    for column in ("owner", "hub"):
        firsts = moved.withColumnsRenamed({"moved": f"{column}_moved", "first": f"{column}_first"})
        named = named.join(firsts, F.col(column) == F.col(f"{column}_moved"), "left")
    held = stored(named.select("key", F.coalesce("owner_first", "owner").alias("node"), F.coalesce("hub_first", "hub").alias("hub")))
    sets = outlines(described)

    def counted(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        cut = stored(segments(among(texts, ends, documents).withColumnRenamed("doc_id", "node"), size))
        links = stored(linked(pairs, cut, similarity, hub_pairs))
        discard(cut)
        return links

    # First every document with the hub it shares most names with: this connects most of what is linked.
    ends = [F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")]
    ties = stored(held.where("node != hub").groupBy(*ends).agg(F.count("*").alias("times")))
    best = F.max(F.struct("times", (-F.col("b")).alias("b"))).alias("best")
    first = stored(ties.groupBy("a").agg(best).select("a", (-F.col("best.b")).alias("b")))
    links = counted(stored(likely(first, sets, similarity, hub_pairs)))
    joined = components(links)
    # Then with its other hubs, and with one other holder of each name, drawn by name and node, so that the
    # names of a document bring it together with different ones; with those of them that it shares most names
    # with, if these are not in its component yet.
    drawn = held.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("other"), F.count("*").alias("holders"))
    drawn = held.join(drawn.where("holders > 2").select("key", "other"), "key").where("node != other")
    asked = drawn.groupBy("node", "other").agg(F.count("*").alias("times"))
    asked = asked.unionByName(ties.select(F.col("a").alias("node"), F.col("b").alias("other"), "times"))
    order = Window.partitionBy("node").orderBy(F.desc("times"), F.xxhash64("node", "other"), "other")
    asked = asked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ASKED)
    met = stored(asked.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct())
    others = _apart(met.join(first, ["a", "b"], "left_anti"), joined)
    others = stored(likely(stored(others), sets, similarity, hub_pairs))
    links = stored(links.unionByName(counted(others)))
    joined = components(links)
    # Then, under names whose holders are not yet one component, holders of different ones.
    state = held.join(joined.withColumnRenamed("node", "joined"), F.col("node") == F.col("joined"), "left")
    state = state.select("key", "node", F.coalesce("component", "node").alias("component"))
    apart = state.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = state.join(apart, "key", "left_semi").distinct()
    sized = stored(left.join(sets.drop("sketch"), "node"))
    discard(held)
    x, y = sized.alias("x"), sized.alias("y")
    rest = x.join(y, "key").where((F.col("x.component") < F.col("y.component")) & _may_link("x", "y", similarity))
    rest = rest.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    rest = stored(rest.join(met, ["a", "b"], "left_anti"))
    discard(sized, ties, met)
    more = counted(stored(sifted(rest, sets, similarity, hub_pairs)))
    known = joined.where("node > component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    connected = components(known.unionByName(more).unionByName(equal))
    labels = connected.select(F.col("node").alias("label_id"), "component")
    found = described.join(labels, F.col("doc_id") == F.col("label_id"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_first(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of their component."""
    found = near_duplicates(docs, size, similarity)
    others = found.where("doc_id != component_id").select(F.col("doc_id").alias("other_id")).distinct()
    return docs.join(others, docs["doc_id"] == F.col("other_id"), "left_anti")
