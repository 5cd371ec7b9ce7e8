import random
import re
import time

import numpy as np
import pyarrow as pa

from promptloom.llm import licenses
from promptloom.llm.queries import QUERIES

from .conftest import rows_of, table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def best_alignment(text, template):
    """Smith-Waterman over everything: the most matched words of a best-scoring alignment."""
    score = np.zeros((len(template) + 1, len(text) + 1), int)
    matched = np.zeros_like(score)
    best = (0, 0)
    for i, a in enumerate(template, 1):
        for j, b in enumerate(text, 1):
            options = [(score[i - 1, j - 1] + (1 if a == b else -1), matched[i - 1, j - 1] + (a == b)),
                       (score[i - 1, j] - 1, matched[i - 1, j]), (score[i, j - 1] - 1, matched[i, j - 1]), (0, 0)]
            score[i, j], matched[i, j] = max(options, key=lambda o: o[0])
            if score[i, j] > best[0]:
                best = (score[i, j], matched[i, j])
    return best[1]


def planted(seed=1, count=60):
    draw = random.Random(seed)
    fill = [f"f{k}" for k in range(100)]
    rows = []
    for i in range(count):
        license, text = draw.choice(licenses.TEMPLATES)
        w = text.split()
        for _ in range(draw.randint(0, len(w) // 20)):
            w[draw.randrange(len(w))] = draw.choice(fill)
        body = draw.choices(fill, k=draw.randint(0, 40)) + w + draw.choices(fill, k=draw.randint(0, 40))
        rows.append((i, " ".join(body), license))
    return rows


def test_planted_templates(spark):
    rows = planted()
    ours = {r.doc_id: r for r in licenses.report(table(spark, [r[:2] for r in rows])).collect()}
    for i, text, license in rows:
        own = words(text)
        coverage = {}
        for name, template in licenses.TEMPLATES:
            t = words(template)
            coverage[name] = max(coverage.get(name, 0), best_alignment(own, t) / len(t))
        assert license in ours[i].licenses.split(",") or coverage[license] < 0.8 or max(
            v for k, v in coverage.items() if k != license
        ) >= coverage[license], (text, ours[i])
        for m in ours[i].matches:
            assert m.coverage >= 0.8 and abs(m.coverage - coverage[m.license]) < 1e-9 or m.coverage <= coverage[m.license]
            assert 0 <= m.start < m.end <= len(own)


def test_clean_and_odd_texts(spark, nasty):
    ours = licenses.report(table(spark, nasty))
    assert ours.count() == len(nasty) and ours.where("n_matches > 0").count() == 0
    assert licenses.report(table(spark, [])).count() == 0


def test_lines_and_spans(spark):
    rows = [(1, "a b.\nReleased under the MIT License.\nc"), (2, None), (3, "Licensed under CC BY-NC 4.0. x Licensed under the Apache License, Version 2.0.")]
    ours = {r.doc_id: r for r in licenses.report(table(spark, rows)).collect()}
    assert [(m.license, m.start, m.end, m.coverage) for m in ours[1].matches] == [("MIT", 2, 7, 1.0)]
    assert ours[2].n_matches == 0 and ours[3].licenses == "Apache-2.0,CC-BY-NC-4.0"
    assert [(m.start, m.end) for m in ours[3].matches] == [(0, 7), (8, 16)]


def test_winnowing_keeps_a_shared_fingerprint():
    draw = np.random.default_rng(4)
    for _ in range(300):
        shared = draw.integers(0, 50, licenses.SPREAD).astype(np.uint64)
        texts = [np.concatenate([draw.integers(0, 50, 6), shared, draw.integers(0, 50, 6)]).astype(np.uint64) for _ in range(2)]
        kept = [set(t[6:9][licenses.winnowed(t, np.zeros(len(t)))[6:9]]) for t in texts]
        assert kept[0] & kept[1]


def test_query(spark, sf):
    stored = rows_of(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    lines = {"MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
             "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    ours = dict(rows_of(QUERIES["op4_licenses"](spark, sf), "doc_id", "licenses"))
    assert len(ours) == len(stored)
    for i, text in stored:
        for name, line in lines.items():
            if line in (text or ""):
                assert name in ours[i].split(",")
        assert ours[i] == "" or re.search("licen[sc]|CC BY", text, re.IGNORECASE)


def test_batches():
    found = licenses.find(licenses.Index(), pa.array([None, "", "Released under the MIT License."]))
    assert [len(f) for f in found] == [0, 0, 1]


def test_repeated_lines_are_all_found():
    line = "Released under the MIT License."
    texts = [" ".join([line] * n) for n in (2, 4, 9)] + [f"{line} x {line} y z {line}"]
    found = licenses.find(licenses.Index(), pa.array(texts))
    assert [[(m.start, m.end) for m in f] for f in found[:3]] == [[(5 * k, 5 * k + 5) for k in range(n)] for n in (2, 4, 9)]
    assert [(m.start, m.end) for m in found[3]] == [(0, 5), (6, 11), (13, 18)]


def test_a_changed_word_hides_no_short_template():
    lines = [t for _, t in licenses.TEMPLATES if 5 <= len(words(t)) <= 12]
    for line in lines:
        own = words(line)
        for k in range(len(own)):
            text = own[:k] + ["zzz"] + own[k + 1 :]
            found = licenses.find(licenses.Index((("L", line),)), pa.array(["q r s " + " ".join(text) + " t u"]))[0]
            best = best_alignment(text, own)
            assert [m.matched for m in found] == ([best] if best >= 0.8 * len(own) else []), text
    found = licenses.find(licenses.Index(), pa.array(["Released under the MIT Licence", "Unlicensed"]))
    assert [[m.license for m in f] for f in found] == [["MIT"], []]
    assert len(licenses.find(licenses.Index((("U", "Unlicensed"),)), pa.array(["a Unlicensed b"]))[0]) == 1


def test_winnowed_templates_are_found():
    """Of long templates that must be there nearly whole a winnowed index finds what a full one does."""
    draw = random.Random(7)
    long = tuple((f"L{k}", " ".join(f"v{draw.randrange(300)}" for _ in range(n))) for k, n in enumerate((300, 500)))
    few, every = licenses.Index(long, 0.95), licenses.Index(long, 0.8)
    assert licenses.stretch_for(300, 0.95) > 1 and licenses.stretch_for(300, 0.8) == licenses.stretch_for(5, 0.95) == 1
    assert sum(len(k[0]) for k in few.keys.values()) < 0.7 * sum(len(k[0]) for k in every.keys.values())
    found = 0
    for name, text in long * 8:
        w = text.split()
        for _ in range(draw.randrange(len(w) // 30)):
            at = draw.randrange(len(w))
            w[at : at + draw.randint(0, 1)] = draw.choice([[], ["zz"], ["zz", "yy"]])
        body = pa.array([" ".join(["a", "b", *w, "c"])])
        ours, full = (licenses.find(index, body, 0.95)[0] for index in (few, every))
        assert ours == full
        found += len(ours)
    assert found >= 10


def test_many_repeats_cost_their_number():
    line = "Released under the MIT License."
    texts = [pa.array([" ".join([line] * n)]) for n in (1000, 4000)]
    index, took = licenses.Index(), []
    for text, n in zip(texts, (1000, 4000)):
        start = time.process_time()
        found = licenses.find(index, text)[0]
        took.append(time.process_time() - start)
        assert [(m.start, m.end) for m in found] == [(5 * k, 5 * k + 5) for k in range(n)]
    assert took[1] < 8 * took[0] + 0.5
