import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from promptloom.llm import conversations
from promptloom.llm.queries import QUERIES

from .conftest import rows_of

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TYPE = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("depth", T.StringType()),  # clashing names
        T.StructField("k1", T.DoubleType()),
    ]
)


def conversation_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], TYPE)


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(o, key=lambda x: x[:2])] for c, o in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in whole.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, convs in members.items():
        cost = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            saved[key[:d]] += cost
            leaves[key[:d]] += not children[key]
    return sorted(
        (
            (
                min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), children[key], leaves[key],
                saved[key], hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest(),
            )
            for key, convs in members.items()
        ),
        key=repr,
    )


def random_rows(seed, convs=120, most=6, texts=("a b", "c", "", None, "a  b\n", "d e f")):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-60, 400), convs):
        rows += [(c, t, draw.choice(["user", "bot", None]), draw.choice(texts)) for t in range(draw.randint(1, most))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = random_rows(seed)
    random.Random(seed).shuffle(rows)
    assert rows_of(conversations.trie(conversation_table(spark, rows).repartition(5)), *NAMES) == expected(rows)


def test_nasty_rows(spark):
    rows = random_rows(7, convs=30)
    rows += [(None, 1, "user", "lost"), (0, None, "user", "before all"), (0, None, "user", "before all"), (0, 2, "bot", "tie")]
    rows += [(0, 2, "user", "tie"), (40, 1, "user", "long " * 50000), (61, 5, None, None), rows[0], rows[1]]
    rows += [(c, t, "user", "same") for c in range(100, 180) for t in range(8)]  # one conversation many times
    rows += [(9, t, "user", "w" * (t % 3)) for t in range(700)]  # a long one
    assert rows_of(conversations.trie(conversation_table(spark, rows)), *NAMES) == expected(rows)


def test_turnless_and_single(spark):
    rows = [(c, 0, "user", "hello") for c in range(21, 40)]  # first of the family is absent
    assert rows_of(conversations.trie(conversation_table(spark, rows)), *NAMES) == expected(rows)
    rows = [(20, 0, "user", "hello")]
    assert rows_of(conversations.trie(conversation_table(spark, rows)), *NAMES) == expected(rows)


def test_empty_table(spark):
    assert conversations.trie(conversation_table(spark, [])).count() == 0
    assert conversations.trie(conversation_table(spark, [(None, 1, "user", "x")])).count() == 0


def test_long_end_lists_are_hashed_in_pieces(spark):
    rows = [(c, 0, "user", "hello") for c in range(0, 60000, 7)]
    assert rows_of(conversations.trie(conversation_table(spark, rows)), *NAMES) == expected(rows)


def test_many_children_are_looked_up(spark):
    rows = [(20 * c, t, "user", f"{c if t else c % 3} x") for c in range(3000) for t in range(2)]
    assert rows_of(conversations.trie(conversation_table(spark, rows)), *NAMES) == expected(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_conversations"](spark, sf), *NAMES) == expected(rows)
