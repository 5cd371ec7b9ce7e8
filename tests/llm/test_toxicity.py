import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from promptloom.llm import toxicity
from promptloom.llm.queries import QUERIES
from promptloom.llm.words import PUNCTUATION, Words

from .conftest import rows_of, table


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


TERMS = ["zorb", "zorbel", "quagmire", "wretchling", "wretchlings", "ab", "éclairé", "quam*", "zorbé*"]


def nearest(word):
    near = [(edits(word, t) if t[-1] != "*" else 0 if word.startswith(t[:-1]) else 9, n) for n, t in enumerate(TERMS)]
    near = [(e, n) for e, n in near if e <= toxicity.allowed_edits(TERMS[n])]
    return min(near)[::-1] if near else None


def test_automata_find_the_nearest_term():
    draw = random.Random(1)
    lexicon = toxicity.Lexicon(TERMS)
    found = 0
    for _ in range(6000):
        word = list(draw.choice(TERMS).replace("*", "ent"))
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(word))
            word[at : at + draw.randint(0, 1)] = draw.choice(["", draw.choice("zorbelquagmirwtchnsé")])
        word = "".join(word)
        assert lexicon.nearest(word) == nearest(word), word
        found += lexicon.nearest(word) is not None
    assert found > 1000


def test_the_filter_before_the_automata_loses_nothing():
    draw = random.Random(2)
    words = []
    for _ in range(3000):
        word = list(draw.choice(TERMS).replace("*", "ent"))
        for _ in range(draw.randint(0, 2)):
            at = draw.randint(0, len(word))
            word[at : at + draw.randint(0, 1)] = draw.choice(["", draw.choice("zorbé")])
        words.append("".join(word) or "x")
    batch = Words(pa.array([" ".join(words), None, "zorb"]), PUNCTUATION, lower=True)
    want = [(k, *nearest(w)) for k, w in enumerate([*words, "zorb"]) if nearest(w)]
    assert toxicity.Lexicon(TERMS).hits(batch) == want


def test_context():
    texts = ["such a zorb here", 'he said "zorb" as a word', "you zorb go away"]
    words = Words(pa.array(texts), PUNCTUATION, lower=True)
    hits = toxicity.Lexicon(TERMS).hits(words)
    plain, quoted, addressed = (toxicity.context_weight(words, at, k) for k, (at, _, _) in enumerate(hits))
    assert quoted < plain < addressed


def test_beginnings_stand_for_their_words():
    rated = [("grolik", 90.0), ("gro*", 95.0), ("grolm*", 60.0), ("mur*", 80.0), ("murk", 40.0), ("mu*", 50.0), ("solo", 70.0), ("sol*", 71.0)]
    assert toxicity.chosen_terms(rated, 9) == ["grolik", "grolm*", "mur*", "solo"] or toxicity.chosen_terms(rated, 9) == ["grolik", "mur*", "solo", "grolm*"]


def test_words_under_a_beginning_keep_their_edits(spark):
    draw = random.Random(5)
    words = [f"calm{k}" for k in range(300)]
    rows = [(" ".join([*draw.sample(words, 8), *(["quagmire" + draw.choice(["", "s", "d"])] if k % 10 == 0 else [])]), int(k % 10 == 0)) for k in range(600)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    lexicon = toxicity.Lexicon(terms)
    assert any(t.endswith("*") and "quagmires".startswith(t[:-1]) for t in terms)
    assert lexicon.nearest("qxagmire") and lexicon.nearest("quxgmires")
    batch = pa.array(["a quagmire here", "a qxagmire here", "a quagmire, a qxagmire", "calm1"])
    found = toxicity.features(lexicon, batch)[:, 3]
    assert np.allclose(found, np.log1p([1, 1, 1, 0]))  # spelled so or so, it is one term


def test_every_significant_term_is_learned(spark):
    draw = random.Random(6)
    syllables = ["ba", "de", "fi", "go", "ku", "lam", "nev", "pir", "sot", "zul"]
    bad = ["".join(draw.sample(syllables, 3)) for _ in range(600)]
    bad = sorted({b[::-1] for b in bad})[:300]
    rows = []
    for _ in range(10):
        draw.shuffle(bad)
        rows += [(" ".join(bad[k : k + 30]), 1) for k in range(0, len(bad), 30)]
    rows += [(" ".join(f"calm{draw.randrange(400)}" for _ in range(30)), 0) for _ in range(1000)]
    lexicon = toxicity.Lexicon(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")))
    assert len(bad) == 300 and all(b in lexicon.terms for b in bad)
    assert len(lexicon.hits(Words(pa.array([" ".join(bad)]), PUNCTUATION, lower=True))) == 300


def test_the_sample_loses_near_copies_only(spark):
    draw = random.Random(7)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage = words(30)
    texts = ["you zorb", "you zorbel", "zorb", "You, zorb!", *(" ".join([*words(25), *passage, *words(25)]) for _ in range(40))]
    long = words(400)
    texts += [" ".join(long), " ".join([*long[:200], "other", *long[200:]])]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = list(zip(ids, texts))
    marks = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, toxic int")
    kept = [r.text for r in toxicity.labelled_sample(table(spark, rows), marks).collect()]
    assert {"you zorbel", "zorb"} <= set(kept) and len({"you zorb", "You, zorb!"} & set(kept)) == 1
    shared = [t for t in texts[4:44] if t in kept]
    assert len(shared) >= 38 and len(kept) <= len(texts) - 1


def corpus(count=900, seed=3):
    draw = random.Random(seed)
    calm = [f"calm{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(count):
        toxic = draw.random() < 0.15
        w = draw.choices(calm, k=draw.randint(5, 60))
        if toxic:
            for _ in range(draw.randint(1, 3)):
                term = draw.choice(TERMS[1:4])
                if draw.random() < 0.3:
                    at = draw.randrange(len(term))
                    term = term[:at] + draw.choice("xyz") + term[at + 1 :]
                w.insert(draw.randrange(len(w)), term)
            if draw.random() < 0.3:  # words that only begin alike
                w = [x for x in w if x.startswith("calm")]
                w += ["drofl" + draw.choice("abcde") + draw.choice("fghij") + draw.choice("klmno") for _ in range(3)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_from_labels(spark):
    rows, labels = corpus()
    rows += [(5000, None), (5001, ""), (None, "zorbel zorbel"), rows[0], rows[0]]
    marks = spark.createDataFrame([(i, 1, t) for i, t in labels] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    ours = toxicity.report(table(spark, rows), marks).collect()
    assert len(ours) == len(rows)
    by_id = {r.doc_id: r for r in ours}
    held = [(by_id[i], t) for i, t in labels if by_id[i].held_out]
    assert {r.doc_id for r, _ in held} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    right = np.mean([r.predicted == t for r, t in held])
    assert right > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in ours)
    assert by_id[5000].score == by_id[5001].score < 0.3 and by_id[None].predicted == 1 and not by_id[None].held_out
    left = toxicity.remove_toxic(table(spark, rows), marks)
    assert left.columns == table(spark, rows).columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(r.doc_id or -1 for r in ours if not r.predicted)


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 1, 1)]])
def test_too_few_labels(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.report(table(spark, [(1, "a b"), (2, None)]), marks).collect()
    assert len(rows) == 2 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.report(table(spark, []), marks).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    ours = QUERIES["op3_toxicity"](spark, sf)
    labels = dict(rows_of(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "toxic"))
    held = [(r.score, labels[r.doc_id]) for r in ours.where("held_out").collect() if r.doc_id in labels]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    better = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert better > 0.75 and np.mean([s >= 0.3 for s in clean]) < 0.05


def test_very_long_terms():
    draw = random.Random(3)
    terms = ["".join(draw.choices("abcdefgh", k=n)) for n in (5, 9, 60, 300, 800, 900, 1500)]
    terms += ["".join(draw.choices("ijklm", k=800)) for _ in range(60)]
    lexicon = toxicity.Lexicon(terms)
    for number, term in enumerate(terms):
        at = len(term) // 2
        for word in (term, term[:at] + "z" + term[at + 1 :], "z" + term, term[:-1]):
            found = lexicon.hits(toxicity.Words(pa.array([f"so {word} there"]), toxicity.PUNCTUATION, lower=True))
            assert [h[1] for h in found] == [number], len(term)
    assert not lexicon.hits(toxicity.Words(pa.array(["q" * 5000 + " " + "a" * 800]), toxicity.PUNCTUATION, lower=True))


def test_toxic_texts_that_share_a_very_long_word(spark):
    run = "".join(random.Random(6).choices("abcdefgh", k=800))
    rows = [(k, f"some plain words {k} of text" + (f" with {run}" if k % 10 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k, _ in rows], "doc_id long, toxic int")
    found = toxicity.report(table(spark, rows), labels).collect()
    assert len(found) == 400 and all(r.predicted == (r.doc_id % 10 == 0) for r in found)
