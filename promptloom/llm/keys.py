"""Which owners share a key: a shuffle of packed 64-bit keys.

A batch of documents gives pairs (key, owner). The batch keeps, for each key, its smallest owner
(the leader) and whether it has others (followers). Leaders go to the shard of their key, so a key
that very many owners hold brings at most one pair from each batch; followers know already that a
smaller owner exists and go to any shard, so they spread evenly. Pairs travel as packed arrays, one
row for each batch and shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from promptloom.llm.words import BATCH_BYTES, pack, slices, unpack

SCHEMA = "shard int, keys binary, owners binary, leaders binary, followed binary"
_NAMES = ["shard", "keys", "owners", "leaders", "followed"]
#: Shards for each shuffle partition, at most: a task holds one at a time, and partitions come out even.
SHARDS_PER_PARTITION = 8
#: Bytes of text behind a shard: each batch has a row for each shard, so small tables get fewer of them.
SHARD_BYTES = 4 << 20


def shards_of(df: DataFrame, text_bytes: int | None = None) -> int:
    """Shards of keys: one for each ``SHARD_BYTES`` of text, but one for each shuffle partition at
    least and ``SHARDS_PER_PARTITION`` at most; the most where the size of the text isn't known."""
    partitions = _partitions(df)
    most = SHARDS_PER_PARTITION * partitions
    return most if text_bytes is None else min(most, max(partitions, -(-text_bytes // SHARD_BYTES)))


def _groups(values: np.ndarray) -> np.ndarray:
    """Flags of the first of each run of equal values."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return first


def pack_pairs(batch: pa.RecordBatch, owner: str, keys_of: Callable, shards: int) -> pa.RecordBatch | None:
    """Packed pairs of a batch. ``keys_of`` gives the keys of a batch and the row of each, the rows
    in ascending order; it gets the batch sorted by ``owner``, without null owners."""
    batch = batch.filter(pa.compute.is_valid(batch[owner]))
    batch = batch.take(pa.compute.array_sort_indices(batch[owner]))
    keys, rows = keys_of(batch)
    if not len(keys):
        return None
    ids = batch[owner].to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], ids[rows[order]]
    first = _groups(keys)
    different = first | _groups(owners)
    heads = np.flatnonzero(first)
    leader_of = np.repeat(owners[heads], np.diff(np.append(heads, len(keys))))
    follows = different & ~first
    lead, led = keys[heads], owners[heads]
    followed = np.add.reduceat(follows, heads) > 0
    edges = _shard_edges(lead, shards)
    rest = [keys[follows], owners[follows], leader_of[follows]]
    found = []
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[shard], edges[shard + 1])
        found.append((shard, pack(lead[part]), pack(led[part]), b"", pack(followed[part])))
    step = max(-(-len(rest[0]) // shards), 4096)
    for at in range(0, len(rest[0]), step):  # any shard will do
        part = slice(at, at + step)
        found.append(((int(ids[0]) + at // step) % shards, *(pack(r[part]) for r in rest), b""))
    kinds = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], _NAMES)


def pairs(docs: DataFrame, owner: str, keys_of: Callable, most: int = BATCH_BYTES, shards: int | None = None) -> DataFrame:
    """Packed pairs of all batches of (owner, text), of ``most`` bytes of text; see ``pack_pairs``."""
    shards = shards or shards_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=most):
            packed = pack_pairs(batch, owner, keys_of, shards)
            if packed is not None:
                yield packed

    return docs.select(owner, "text").mapInArrow(run, SCHEMA)


def _shard_edges(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each shard begin: shards are equal ranges of keys."""
    cuts = [(s << 64) // shards for s in range(1, shards)]
    inner = np.searchsorted(sorted_keys, np.array(cuts, np.uint64))
    return np.concatenate([[0], inner, [len(sorted_keys)]])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one shard after another; a partition's rows come sorted by shard."""
    rows, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != now and rows:
                yield rows
                rows = []
            now = row["shard"]
            rows.append(row)
    if rows:
        yield rows


def _joined(rows: list[dict], column: str, kind) -> np.ndarray:
    parts = [unpack(r[column], kind) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _leaders(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owners, smallest owner of the key, whether the key has several owners), by key."""
    own = [r for r in rows if not r["leaders"]]
    keys, owners, followed = _joined(own, "keys", np.uint64), _joined(own, "owners", np.int64), _joined(own, "followed", bool)
    if not len(keys):
        return keys, owners, owners, followed
    order = np.lexsort((owners, keys))
    keys, owners, followed = keys[order], owners[order], followed[order]
    heads = np.flatnonzero(_groups(keys))
    sizes = np.diff(np.append(heads, len(keys)))
    least, most = np.repeat(owners[heads], sizes), np.repeat(np.maximum.reduceat(owners, heads), sizes)
    shared = (least != most) | np.repeat(np.logical_or.reduceat(followed, heads), sizes)
    return keys, owners, least, shared


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_shard(entries: DataFrame, run, schema: str) -> DataFrame:
    return entries.repartition(_partitions(entries), "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def buckets_of(df: DataFrame) -> int:
    """Buckets of owners: a prime not much above the shuffle partitions, so that ids with a step
    between them spread as well."""
    count = _partitions(df) + 1
    while any(count % k == 0 for k in range(2, int(count**0.5) + 1)):
        count += 1
    return count


def _by_bucket(owners: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, owners, values), packed, of each bucket that has any; by owner, then value."""
    order = np.lexsort((values, owners, owners % buckets))
    owners, values = owners[order], values[order]
    edges = np.searchsorted(owners % buckets, np.arange(buckets + 1))
    return [
        (k, pack(owners[edges[k] : edges[k + 1]]), pack(values[edges[k] : edges[k + 1]]))
        for k in np.flatnonzero(np.diff(edges)).tolist()
    ]


#: Pairs that a task gathers over its shards before it deals them out to buckets.
GATHERED = 1_000_000


def _dealt(found: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs (owners, values) of one shard after another, in a row for each bucket."""
    kinds, parts = (pa.int32(), pa.binary(), pa.binary()), []

    def rows() -> pa.RecordBatch:
        owners, values = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*_by_bucket(owners, values, buckets)), kinds)], names)

    for owners, values in found:
        if len(owners):
            parts.append((owners, values))
        if sum(len(p[0]) for p in parts) >= GATHERED:
            yield rows()
            parts.clear()
    if parts:
        yield rows()


def held(entries: DataFrame, later: bool) -> DataFrame:
    """(bucket, owners, keys), packed: the keys that owners share with others; with ``later`` only
    those that a smaller owner holds too. One row for each task and bucket of owners."""
    buckets = buckets_of(entries)

    def shares(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        keys, owners, least, shared = _leaders(rows)
        wanted = owners > least if later else shared
        rest = [r for r in rows if r["leaders"]]
        keys = np.concatenate([keys[wanted], _joined(rest, "keys", np.uint64)])
        return np.concatenate([owners[wanted], _joined(rest, "owners", np.int64)]), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(map(shares, _shards(batches)), buckets, ["bucket", "owners", "keys"])

    return _by_shard(entries, run, "bucket int, owners binary, keys binary")


def shared(entries: DataFrame) -> DataFrame:
    """(key, owner, hub) of the keys that several owners hold: the hub is the smallest owner of the
    key, or of the batch, which is tied to the smallest itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            keys, owners, least, several = _leaders(rows)
            rest = [r for r in rows if r["leaders"]]
            columns = (
                np.concatenate([keys[several], _joined(rest, "keys", np.uint64)]).view(np.int64),
                np.concatenate([owners[several], _joined(rest, "owners", np.int64)]),
                np.concatenate([least[several], _joined(rest, "leaders", np.int64)]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "owner", "hub"])

    return _by_shard(entries, run, "key long, owner long, hub long")


class Found:
    """The keys that were found for the owners of a bucket."""

    def __init__(self, rows: pa.Table):
        rows = rows.select(["owners", "keys"]).to_pylist()
        owners, keys = _joined(rows, "owners", np.int64), _joined(rows, "keys", np.uint64)
        order = np.argsort(owners, kind="stable")
        self.owners, self.keys = owners[order], keys[order]

    def of(self, owner: int | None) -> np.ndarray:
        if owner is None:
            return self.keys[:0]
        lo, hi = np.searchsorted(self.owners, [owner, owner + 1])
        return self.keys[lo:hi]


#: Bytes of text of a group of documents that one call holds, on average.
GROUP_BYTES = 32 << 20


def text_bytes_of(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def salts_for(docs: DataFrame, group_bytes: int = GROUP_BYTES, total: int | None = None) -> int:
    """In how many groups the documents of a bucket are to be dealt out; ``total``: bytes of text, if known."""
    total = text_bytes_of(docs) if total is None else total
    return max(1, -(-total // (buckets_of(docs) * group_bytes)))


def meet(docs: DataFrame, owner: str, found: DataFrame, run: Callable, schema: str, salts: int = 1) -> DataFrame:
    """Rows of ``run(batch, found)`` for all batches of (owner, text), each with what ``held`` has
    found for their owners. Rows without an owner are spread by their text and find nothing. The
    rows of a bucket, those of one owner too, are dealt out to ``salts`` groups by their content and
    place; what was found for the bucket goes to each."""
    buckets = buckets_of(docs)
    by_owner = F.pmod(F.col(owner), F.lit(buckets))
    bucket = F.coalesce(by_owner, F.pmod(F.xxhash64("text"), F.lit(buckets))).cast("int")
    salt = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)

    def together(texts: pa.Table, rows: pa.Table) -> pa.Table:
        own = Found(rows)
        parts = [run(batch, own) for batch in slices(texts.combine_chunks().select([owner, "text"]).to_batches())]
        return pa.Table.from_batches([p for p in parts if p is not None], schema=empty)

    empty = to_arrow_schema(_parse_datatype_string(schema))
    texts = docs.select(bucket.alias("bucket"), salt.alias("salt"), owner, "text")
    everywhere = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    return texts.groupBy("bucket", "salt").cogroup(everywhere.groupBy("bucket", "salt")).applyInArrow(together, schema)


def links(entries: DataFrame) -> DataFrame:
    """(a, b), a > b, each once: every owner of a key is tied to the smallest owner, over the leader
    of its batch. Owners of one key are so connected, with one link each."""
    buckets = buckets_of(entries)

    def ties(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        _, owners, least, _ = _leaders(rows)
        rest = [r for r in rows if r["leaders"]]
        a = np.concatenate([owners[owners > least], _joined(rest, "owners", np.int64)])
        return _once(a, np.concatenate([least[owners > least], _joined(rest, "leaders", np.int64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(map(ties, _shards(batches)), buckets, ["shard", "a", "b"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            a, b = _once(_joined(rows, "a", np.int64), _joined(rows, "b", np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    packed = _by_shard(entries, run, "shard int, a binary, b binary")
    return _by_shard(packed, merged, "a long, b long")


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = _groups(a) | _groups(b)
    return a[new], b[new]
