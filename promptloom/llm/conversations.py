"""The prefix trie of rebuilt conversations, without building a trie.

Identical conversations collapse into one weighted sequence with a list of ends. A sequence is a
leaf if no other sequence goes on from it (anti-join with all proper prefixes). What the trie says
of a node is then a sum over the weighted sequences that begin with it: one row for each sequence
and depth, added up by prefix.

A prefix is named by the exclusive or of 128-bit digests of (depth, role, text), so that names of all
prefixes come from one running aggregate, and no text travels. Sums over subtrees stay linear in the
turns: the nodes of a sequence whose smallest member it is (its own nodes) are a tail of its path,
so every node of the trie belongs to the tail of exactly one sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from promptloom.session import stored

#: Conversations with ids from c to c + 19 may begin like conversation c.
FAMILY = 20
#: At most so many turns (less one) are taken from the first of a family.
MOST_TAKEN = 4
#: Ids of a piece of an end list: 2 ** 12.
PIECE_BITS = 12
#: A node with more than this share of all nodes as children is looked up by broadcast: fewer than
#: this many nodes are.
HOT_PARENTS = 1024

KEY = ["k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, content, words): digest of role and text, and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("content"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def taken(conv_id):
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_TAKEN


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, position, content, words): the turns of all rebuilt conversations, in order of
    part and position, and a first row for the root of each."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "content")
    placed = turns.withColumn("position", F.row_number().over(order)).drop("turn")
    h = taken(F.col("conv_id"))
    own = placed.where(F.col("position") > h).withColumn("part", F.lit(1))
    ids = turns.select("conv_id").distinct()
    first = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("position") < MOST_TAKEN))
    heads = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), h.alias("h"))
    begun = heads.where("h > 0").join(first.withColumnRenamed("conv_id", "first"), "first").where("position <= h")
    roots = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("position"), F.lit("").alias("content"), F.lit(0).cast("long").alias("words"))
    columns = ["conv_id", "part", "position", "content", "words"]
    return own.select(columns).unionByName(begun.withColumn("part", F.lit(0)).select(columns)).unionByName(roots)


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, path, last): every prefix of every rebuilt conversation,
    its name, that of its parent, the words of its last turn and of all its turns."""
    order = Window.partitionBy("conv_id").orderBy("part", "position")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = rebuilt(turns_of(conversations)).withColumn("depth", F.row_number().over(order).cast("long") - 1)
    digest = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("content")).cast("binary"))

    def half(start: int):
        return F.when(F.col("depth") > 0, F.conv(F.substring("digest", start, 16), 16, -10).cast("long")).otherwise(F.lit(0).cast("long"))

    named = deep.withColumn("digest", digest).select("conv_id", "part", "position", "depth", "words", half(1).alias("d1"), half(17).alias("d2"))
    run = named.select(
        "conv_id", "depth", "words", "d1", "d2",
        F.bit_xor("d1").over(so_far).alias("k1"),
        F.bit_xor("d2").over(so_far).alias("k2"),
        F.sum("words").over(so_far).alias("path"),
        F.lead("depth").over(order).isNull().alias("last"),
    )
    p1, p2 = F.col("k1").bitwiseXOR(F.col("d1")), F.col("k2").bitwiseXOR(F.col("d2"))
    return run.select("conv_id", "depth", *KEY, p1.alias("p1"), p2.alias("p2"), "words", "path", "last")


def collapse(rows: DataFrame) -> DataFrame:
    """(rep, length, total, n, is_leaf): each different rebuilt conversation once, by its smallest
    member, with its turns, words and members, and whether no other goes on from it."""
    ends = rows.where("last").groupBy(*KEY).agg(
        F.min("conv_id").alias("rep"), F.max("depth").alias("length"), F.max("path").alias("total"), F.count("*").alias("n")
    )
    proper = rows.where("NOT last").select(*KEY).distinct()
    leaves = ends.join(proper, KEY, "left_anti").select(F.col("rep").alias("leaf"))
    flagged = ends.join(leaves, F.col("rep") == F.col("leaf"), "left")
    return flagged.select("rep", "length", "total", "n", F.col("leaf").isNotNull().cast("long").alias("is_leaf"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal names: pieces come in order, one at a time."""
    now, digest, done = None, None, []
    for batch in batches:
        for k1, k2, ids in zip(*(batch[n].to_pylist() for n in (*KEY, "ids"))):
            if (k1, k2) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _rows(done)
        done = []
    if now is not None:
        yield _rows([(*now, digest.hexdigest())])


def _rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of all prefixes at which a conversation ends.

    An end list is cut into pieces by ranges of ids, each a row of bounded size; the pieces of a list
    then pass one hasher in order, one piece in memory at a time, however long the list is.
    """
    piece = F.shiftright("conv_id", PIECE_BITS)
    pieces = rows.where("last").groupBy(*KEY, piece.alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    joined = pieces.select(*KEY, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = joined.repartition(spread, *KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return together.mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first, those of equal ``turn`` by the digest of role and text;
    repeated rows are repeated turns. A null role or text is empty. Rows without conv_id belong to no
    conversation and are left out; without conversations there is no node, not even the root. Only
    the four columns of the contract are read, others may have any name.
    """
    rows = stored(paths(conversations))
    sequences = collapse(rows)
    weighted = stored(rows.drop("last").join(sequences, F.col("conv_id") == F.col("rep")).drop("rep"))
    owners = weighted.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("depth").alias("depth"), F.max("words").alias("words"))
    tails = owners.groupBy("owner").agg(F.min("depth").alias("top"), F.sum("words").alias("own_words"))
    joined = weighted.join(tails, F.col("conv_id") == F.col("owner"), "left")
    top = F.coalesce("top", F.col("length") + 1)  # without own nodes the tail is empty
    rest = F.col("total") - F.col("path") + F.col("words")  # words from this turn on
    own_rest = F.when(F.col("depth") >= top, rest).otherwise(F.coalesce("own_words", F.lit(0)))
    goes_on = (F.col("depth") >= top - 1) & (F.col("depth") < F.col("length"))
    nodes = joined.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
        F.sum("n").alias("n_convs"),
        F.sum(goes_on.cast("long")).alias("n_children"),
        F.sum("is_leaf").alias("n_leaves"),
        F.sum(F.col("n") * rest - own_rest).alias("saved_tokens"),
        F.max((F.col("depth") == top).cast("int")).alias("at_top"),  # true of the owner's row alone
    )
    ended = nodes.join(end_digests(rows), KEY, "left")
    return _with_parents(stored(ended.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """A node below the top of its owner's tail has a parent of the same owner; others look theirs up,
    nodes with very many children by broadcast (there are fewer than ``HOT_PARENTS``)."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = nodes.where("at_top = 0 OR depth = 0")
    inside = inside.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("c"))
    hot = F.col("c") * HOT_PARENTS > max(nodes.count(), 1)
    tops = nodes.where("at_top = 1 AND depth > 0")
    many = F.broadcast(parents.where(hot).drop("c"))
    quick = tops.join(many, ["p1", "p2"])
    others = tops.join(many, ["p1", "p2"], "left_anti").join(parents.where(~hot).drop("c"), ["p1", "p2"])
    return inside.select(columns).unionByName(quick.select(columns)).unionByName(others.select(columns))
