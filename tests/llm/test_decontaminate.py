import hashlib
import random
import re

import pyarrow as pa
from promptloom.llm import decontaminate
from promptloom.llm.queries import QUERIES

from .conftest import nasty_texts, rows_of, table

NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, window=13, share=20):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    found = []
    for i, text in docs:
        w = words(text)
        hit, own = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    own |= windows[tuple(w[k : k + size])]
                    hit |= set(range(k, k + size))
        joined = ",".join(sorted(map(str, own)))
        bad = len(hit) > 0 and share * len(hit) >= len(w)
        found.append((i, len(w), len(hit), len(own), hashlib.sha256(joined.encode()).hexdigest(), bad))
    return sorted(found, key=repr)


def items_from(texts, seed=1):
    draw = random.Random(seed)
    items = [(0, None), (1, ""), (2, "-- !"), (3, "one"), (10, "x1 zzz"), (11, "é the a")]
    for k in range(40):
        w = words(draw.choice(texts))
        at = draw.randint(0, max(0, len(w) - 20))
        items.append((100 + k, " ".join(w[at : at + draw.randint(1, 30)])))
    return items + [items[8], (100, "b b b a a a")]


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_nasty_documents(spark, nasty):
    items = items_from(nasty_texts())
    ours = decontaminate.report(table(spark, nasty), benchmark(spark, items))
    assert rows_of(ours, *NAMES) == expected(nasty, items)


def test_long_items_only_and_many_blocks(spark, nasty):
    items = [(i, t) for i, t in items_from(nasty_texts(), 2) if len(words(t)) >= 13 or i == 2]
    for size in (1 << 24, 300):
        ours = decontaminate.report(table(spark, nasty), benchmark(spark, items), block_bytes=size)
        assert rows_of(ours, *NAMES) == expected(nasty, items)


def test_empty_tables(spark, nasty):
    assert decontaminate.report(table(spark, []), benchmark(spark, [(1, "a")])).count() == 0
    ours = decontaminate.report(table(spark, nasty), benchmark(spark, []))
    assert rows_of(ours, *NAMES) == expected(nasty, [])
    ours = decontaminate.report(table(spark, nasty), spark.createDataFrame([(None, "a b")], "item_id long, text string"))
    assert ours.where("n_hit > 0").count() == 0


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ours = QUERIES["op6_decontamination"](spark, sf)
    assert rows_of(ours, *NAMES) == expected(docs, items)
    assert ours.where("contaminated").count() > 0


def test_removal_keeps_rows_and_columns(spark, nasty):
    items = items_from(nasty_texts())
    docs = table(spark, nasty)
    left = decontaminate.remove_contaminated(docs, benchmark(spark, items))
    assert left.schema.simpleString() == docs.schema.simpleString()
    clean = sorted((r[0] for r in expected(nasty, items) if not r[5]))
    assert sorted(r.doc_id for r in left.collect()) == clean


def test_longest_matches(spark):
    text = "n o p " + " ".join(f"w{k}" for k in range(30)) + " q " + " ".join(f"w{k}" for k in range(5, 20))
    items = [(7, " ".join(f"w{k}" for k in range(2, 28)))]
    found = decontaminate.longest_matches(table(spark, [(1, text), (2, None)]), benchmark(spark, items))
    assert rows_of(found, "doc_id", "item_id", "doc_start", "item_start", "n_words") == [(1, 7, 34, 3, 15), (1, 7, 5, 0, 26)]


def test_spans(spark):
    items = [(1, "a b c"), (2, "c d")]
    rows = decontaminate.report(table(spark, [(1, "a b c d x a b c"), (2, "a b c"), (3, "a b")]), benchmark(spark, items)).collect()
    assert [[tuple(s) for s in r.spans] for r in sorted(rows)] == [[(0, 4), (5, 8)], [(0, 3)], []]


def test_matches_of_many_blocks(spark):
    w = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(w[7 * k : 7 * k + 40])) for k in range(40)]
    rows = [(1, " ".join(w[3:90])), (1, " ".join(w[100:130])), (None, " ".join(w[50:70])), (2, "x"), (3, None)]
    found = [
        rows_of(decontaminate.report(table(spark, rows), benchmark(spark, items), block_bytes=size), "doc_id", "n_longest", "matches")
        for size in (1 << 24, 900)
    ]
    assert found[0] == found[1]
    longest = {(d, n) for d, n, _ in found[0]}
    assert longest == {(1, 40), (1, 30), (None, 20), (2, 0), (3, 0)}
    for doc, n, matches in found[0]:
        assert max([0, *(m.n_words for m in matches)]) == n


def test_windows_that_can_t_be_there_are_not_searched(monkeypatch):
    draw = random.Random(5)
    vocabulary = [f"v{k}" for k in range(4000)]
    items = [" ".join(draw.choices(vocabulary, k=60)) for _ in range(2000)]
    tests = decontaminate.TestSuffixes(list(range(2000)), items, 13)
    text = " ".join(draw.choices(vocabulary, k=100_000)) + " " + " ".join(items[7].split()[10:40])
    asked = []
    plain = tests.find
    monkeypatch.setattr(tests, "find", lambda text, suffixes, some: asked.append(len(some)) or plain(text, suffixes, some))
    found = decontaminate.matches_of(tests, decontaminate.Words(pa.array([text]), decontaminate.PUNCTUATION, lower=True))
    assert found.tolist() == [[0, 7, 100_000, 10, 30]]
    assert len(tests.starts) > 90_000 and asked[0] < 100  # all but the windows of the passage are left out
