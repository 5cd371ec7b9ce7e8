import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from promptloom.llm import keys, repeats
from promptloom.llm.queries import QUERIES
from promptloom.llm.words import WHITE, Words

from .conftest import nasty_texts, rows_of, table

NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(rows, window=13):
    smallest = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                smallest[key] = min(i, smallest.get(key, i))
    found = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and smallest[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        found.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=repr)


def passages(seed, alphabet, count=80):
    """Texts that share passages of 8 to 40 words, cut anywhere, in random words and in runs."""
    draw = random.Random(seed)
    shared = [draw.choices(alphabet, k=draw.randint(8, 40)) for _ in range(6)]
    texts = []
    for _ in range(count):
        w = []
        for _ in range(draw.randint(0, 5)):
            p = draw.choice(shared)
            lo = draw.randint(0, 6)
            w += draw.choices(alphabet, k=draw.randint(0, 6)) + p[lo : len(p) - draw.randint(0, 6)]
            w += [draw.choice(alphabet)] * draw.choice([0, 0, 1, 2, 3, 20])
        texts.append(" ".join(w))
    return texts


def test_borders_inside_equal_windows_are_equal():
    draw = random.Random(9)
    for size in (1, 2, 3, 30):
        alphabet = [f"w{k}" for k in range(size)]
        for _ in range(300):
            middle = draw.choices(alphabet, k=13)
            sides = [[draw.choices(alphabet, k=draw.randint(0, 9)) for _ in range(2)] for _ in range(2)]
            found = []
            for left, right in sides:
                w = Words(pa.array([" ".join(left + middle + right)]), WHITE)
                starts, names = repeats.anchors(w)
                flags = repeats.borders(w.hashes(), w.text_of())
                at = len(left)
                ends = np.append(flags, True)
                found.append((names[list(starts).index(at)], tuple(ends[at + 5 : at + 9])))
                assert any(found[-1][1][:4])
            assert found[0][0] == found[1][0]
            # the end of a text is no border of a symbol that reaches beyond the window
            assert found[0][1][:3] == found[1][1][:3]


def test_nasty_documents(spark, nasty):
    assert rows_of(repeats.remove_repeats(table(spark, nasty)), *NAMES) == expected(nasty)


def test_shared_passages(spark):
    for seed, alphabet in ((1, ["a", "b"]), (2, list("abcdefgh")), (3, [f"word{k}" for k in range(200)])):
        rows = list(enumerate(passages(seed, alphabet)))
        random.Random(seed).shuffle(rows)
        rows += [(None, rows[0][1]), rows[1]]
        ours = repeats.remove_repeats(table(spark, rows).repartition(7), with_text=True)
        assert rows_of(ours, *NAMES) == expected(rows)
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in ours.collect())


def test_buckets_in_many_groups(spark):
    """Rows of one bucket, and of one id, lie in several groups."""
    rows = list(enumerate(passages(4, list("abcdefgh"), 60)))
    rows += [(7, t) for _, t in rows[10:30]] + [(7, rows[3][1])] * 5 + [(None, rows[0][1])]
    docs = table(spark, rows).repartition(4)
    assert keys.salts_for(docs, 50) > 3
    assert rows_of(repeats.remove_repeats(docs, group_bytes=50), *NAMES) == expected(rows)


def test_empty_table(spark):
    assert repeats.remove_repeats(table(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "a b")]
    assert rows_of(repeats.remove_repeats(table(spark, rows)), *NAMES) == expected(rows)


def test_query(spark, sf):
    stored = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    ours = QUERIES["op9_repeats"](spark, sf)
    assert rows_of(ours, *NAMES) == expected(stored)
    assert ours.where("n_removed > 0").count() > 0


def test_texts_are_nasty():
    assert None in nasty_texts() and "" in nasty_texts()


def test_rows_of_packed_pairs_follow_the_text_not_the_square_of_partitions(spark):
    docs = table(spark, [(k, " ".join(f"w{k % 7}x{j}" for j in range(300))) for k in range(40)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        shards = keys.shards_of(docs, keys.text_bytes_of(docs))
        assert shards == 16 and keys.shards_of(docs, 40 * keys.SHARD_BYTES) == 40
        assert keys.shards_of(docs, 1 << 50) == keys.shards_of(docs) == 128
        got = rows_of(repeats.remove_repeats(docs), *NAMES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=repr) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
