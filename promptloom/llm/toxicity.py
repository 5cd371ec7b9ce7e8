"""Toxicity by a learned lexicon that also catches misspelled terms.

Learning, from a bounded sample of the labelled rows: words, and beginnings of words, that stand in
toxic texts far more often than chance allows make the lexicon (a beginning is written with a star;
words under it stay, for their misspellings), and a logistic model weighs what the lexicon finds in
a text.

Scoring, map-only over all rows: the lexicon is a trie. Every different word of a batch is a
Levenshtein automaton, run over the trie from its root; a branch is left as soon as no state is
alive. Each hit is weighed by the words around it: reporting words and quotation marks speak for
quotation, second-person words for abuse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from promptloom.llm.words import HALF_BATCH_BYTES, PUNCTUATION, Words, mix, sequence_hashes, slices
from promptloom.session import discard, stored

#: Labelled rows that are learned from: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: Toxic texts that a term must stand in.
LEAST_TEXTS = 3
#: Words of a shingle, and orders of shingles, by which near copies are told in the sample: all
#: orders but one must agree.
SHINGLE, SKETCHES = 5, 4
#: Patterns of one expression of the filter before the automata.
FILTER_PATTERNS = 200
#: Letters of one expression (one pattern at least), and letters before a part that are counted.
FILTER_LETTERS, FILTER_PLACE = 8000, 40
#: Letters of a beginning of a word that can be a term.
STEM_LETTERS = range(3, 9)
#: Words on either side of a hit that make its context.
CONTEXT = 8

# Words around a hit that speak for quotation or for abuse.
REPORTING = frozenset("said says called calls quote quoted quotes word words term terms wrote defined definition means".split())
ADDRESSING = frozenset("you your yours u du dich dir dein tu te ti vous vos eres usted".split())
_QUOTES = frozenset('"\'“”‘’«»„`')
QUOTED_WEIGHT, REPORTED_WEIGHT, ADDRESSED_WEIGHT = 0.3, 0.6, 1.3


def allowed_edits(term: str) -> int:
    """Edits at which a word still counts as the term: short terms have too many neighbours, and
    beginnings of words have too many continuations."""
    return 0 if len(term) < 4 or term.endswith("*") else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms, and the automata that are run over it."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.root: dict = {}
        for number, term in enumerate(terms):
            node = self.root
            for letter in term.removesuffix("*"):
                node = node.setdefault(letter, {})
            node["begin" if term.endswith("*") else "whole"] = number
        begun = {t[:-1]: n for n, t in enumerate(terms) if t.endswith("*")}
        #: For each term the shortest beginning that it is under, else itself: they count as one.
        self.stands = [min([(k, begun[t[:k]]) for k in range(1, len(t) + 1) if t[:k] in begun], default=(0, n))[1] for n, t in enumerate(terms)]
        self.reach = max([0, *map(allowed_edits, terms)])
        self.known: dict[str, tuple[int, int] | None] = {}
        # A word within k edits of a term has one of k + 1 parts of the term in its place or close by.
        patterns = set()
        for term in terms:
            if term.endswith("*"):
                patterns.add(f"^{re.escape(term[:-1])}")
                continue
            k = allowed_edits(term)
            cuts = [round(j * len(term) / (k + 1)) for j in range(k + 2)]
            parts = [term[a:b] for a, b in zip(cuts, cuts[1:])]
            # No more than k letters are too many or too few before a part; bytes are counted. Far from
            # the beginning a part may stand anywhere: the expression would be too large.
            for at, part in zip(cuts[1:], parts[1:-1]):
                near = f"^.{{{max(0, at - k)},{4 * (at + k)}}}" if at + k <= FILTER_PLACE else ""
                patterns.add(near + re.escape(part))
            patterns |= {f"^{re.escape(parts[0])}", f"{re.escape(parts[-1])}$"}
        # In pieces, as one expression may be only so large.
        pieces, letters = [[]], 0
        for pattern in sorted(patterns):
            if pieces[-1] and (len(pieces[-1]) == FILTER_PATTERNS or letters + len(pattern) > FILTER_LETTERS):
                pieces.append([])
                letters = 0
            pieces[-1].append(pattern)
            letters += len(pattern)
        self.filters = ["|".join(piece) for piece in pieces if piece]

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the term nearest to the word, of equal ones the first; None if all are
        farther than they may be."""
        if word not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[word] = self._run(word)
        return self.known[word]

    def _run(self, word: str) -> tuple[int, int] | None:
        size, reach = len(word), self.reach
        masks: dict[str, int] = {}
        for at, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 1 << at
        everything = (1 << (size + 1)) - 1
        # state[e]: bit i is set if the first i letters of the word match what was read of the
        # trie with e edits.
        start = [(1 << (e + 1)) - 1 & everything for e in range(reach + 1)]
        best: tuple[int, int] | None = None
        todo = [(self.root, start)]
        while todo:
            node, state = todo.pop()
            for letter, below in node.items():
                if letter == "whole" or letter == "begin":
                    term = below
                    for edits in range(allowed_edits(self.terms[term]) + 1):
                        # The whole word, or as much of it as the term has letters.
                        if state[edits] >> (size if letter == "whole" else len(self.terms[term]) - 1) & 1:
                            if best is None or (edits, term) < best[::-1]:
                                best = (term, edits)
                            break
                    continue
                mask, after, before = masks.get(letter, 0), [], 0
                for e in range(reach + 1):
                    now = (state[e] & mask) << 1
                    if e:
                        # another letter, a letter of the term left out, a letter of the word too many
                        now |= state[e - 1] << 1 | state[e - 1] | before << 1
                    now &= everything
                    after.append(now)
                    before = now
                if any(after):
                    todo.append((below, after))
        return best

    def hits(self, words: Words) -> list[tuple[int, int, int]]:
        """(word of the batch, term, edits) of all hits, in order."""
        if not self.terms or not len(words):
            return []
        spelled = words.array().dictionary_encode()
        different = spelled.dictionary
        wanted = np.zeros(len(different), bool)
        for some in self.filters:
            wanted |= pa.compute.match_substring_regex(different, some).to_numpy(zero_copy_only=False)
        found = {}
        for k in np.flatnonzero(wanted).tolist():
            near = self.nearest(different[k].as_py().decode("utf-8", errors="replace"))
            if near is not None:
                found[k] = near
        if not found:
            return []
        chosen = np.zeros(len(different), bool)
        chosen[list(found)] = True
        numbers = spelled.indices.to_numpy(zero_copy_only=False)
        return [(at, *found[int(numbers[at])]) for at in np.flatnonzero(chosen[numbers]).tolist()]


def context_weight(words: Words, at: int, text: int) -> float:
    """Below 1: the hit looks quoted or reported; above 1: it looks addressed to someone."""
    lo, hi = max(words.bounds[text], at - CONTEXT), min(words.bounds[text + 1], at + CONTEXT + 1)
    offsets, data = words.offsets, words.data
    near = {data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi) if i != at}
    start = int(words.starts[at])
    end = start + int(offsets[at + 1] - offsets[at])
    around = [words.raw[max(0, start - 3) : start].tobytes(), words.raw[end : end + 3].tobytes()]
    before = around[0].decode("utf-8", "ignore")[-1:]
    after = around[1].decode("utf-8", "ignore")[:1]
    weight = 1.0
    if before in _QUOTES and after in _QUOTES and before and after:
        weight *= QUOTED_WEIGHT
    if near & REPORTING:
        weight *= REPORTED_WEIGHT
    if near & ADDRESSING:
        weight *= ADDRESSED_WEIGHT
    return weight


FEATURES = ("exact", "misspelled", "begun", "terms", "density")


def features(lexicon: Lexicon, texts: pa.Array) -> np.ndarray:
    """What the lexicon finds in each text: logarithms of the weighed hits that are exact, misspelled
    and beginnings of words, of the different terms, and of the weighed hits per hundred words. All
    0 without a hit."""
    words = Words(texts, PUNCTUATION, lower=True)
    found = np.zeros((len(texts), len(FEATURES)))
    hits = lexicon.hits(words)
    if hits:
        places = np.searchsorted(words.bounds, [h[0] for h in hits], "right") - 1
        terms: dict[int, set[int]] = {}
        for (at, term, edits), text in zip(hits, places.tolist()):
            weight = context_weight(words, at, text)
            found[text, 2 if lexicon.terms[term].endswith("*") else 0 if edits == 0 else 1] += weight
            terms.setdefault(text, set()).add(lexicon.stands[term])
        for text, own in terms.items():
            found[text, 3] = len(own)
        found[:, 4] = 100 * found[:, :3].sum(axis=1) / np.maximum(words.counts, 20)
    return np.log1p(found)


class Model:
    """Weights of the features, the last one the constant."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.lexicon, self.weights = Lexicon(terms), weights

    def score(self, texts: pa.Array) -> np.ndarray:
        values = features(self.lexicon, texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def logistic(values: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method. Without rows every text is as likely toxic as not seen: rare."""
    if not len(labels):
        return np.array([0.0] * values.shape[1] + [-4.0])
    x = np.hstack([values, np.ones((len(values), 1))])
    penalty = np.diag([ridge] * values.shape[1] + [1e-3])
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ weights)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, m0, m1, ...): the smallest shingle of each text under several orders, of a
    text of fewer words than a shingle its whole sequence of words, 0 without words. Near copies
    share most of them."""
    for batch in slices(batches, most=HALF_BATCH_BYTES):
        words = Words(batch["text"], PUNCTUATION, lower=True)
        hashes = words.hashes()
        shingles, text = sequence_hashes(hashes, SHINGLE), words.text_of()
        at = np.flatnonzero(text[: len(shingles)] == text[SHINGLE - 1 :]) if len(shingles) else np.zeros(0, np.int64)
        shingles, text = shingles[at], text[at]
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        some = np.flatnonzero(np.diff(bounds))
        short = {}
        for size in range(1, SHINGLE):
            own = np.flatnonzero(words.counts == size)
            if len(own):
                short[size] = own, sequence_hashes(hashes, size)[words.bounds[own]]
        columns = [batch["doc_id"], batch["toxic"]]
        for salt in range(SKETCHES):
            least = np.zeros(batch.num_rows, np.uint64)
            if len(some):
                order = mix(shingles ^ mix(np.full(1, salt + 1, np.uint64)))
                least[some] = np.minimum.reduceat(order, bounds[some])
            for own, whole in short.values():
                least[own] = whole
            columns.append(pa.array(least.view(np.int64)))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", *(f"m{k}" for k in range(SKETCHES))])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents that aren't held out, of copies and near
    copies mostly one: else the words of a text with many copies would look like terms. Near copies
    agree in all sketches but one at least; a passage that texts share doesn't make them so. The ids (12 bytes a row, ``rows`` of them) are broadcast,
    the texts are not; they are only read again."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = ids.select(F.col("doc_id").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic"))
    own = docs.select("doc_id", "text").where("text IS NOT NULL")

    def with_text(chosen: DataFrame) -> DataFrame:
        return own.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).drop("labelled_id")

    names = [f"m{k}" for k in range(SKETCHES)]
    left = with_text(ids).mapInArrow(_sketches, "doc_id long, toxic int, " + ", ".join(f"{n} long" for n in names))
    for other in names:  # a toxic text stays rather than a clean one, of equal ones the smaller id
        least = F.min(F.struct((-F.col("toxic")).alias("o"), "doc_id", "toxic", *names)).alias("r")
        left = left.groupBy(*(n for n in names if n != other)).agg(least).select("r.doc_id", "r.toxic", *(f"r.{n}" for n in names))
    chosen = left.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = with_text(chosen.withColumnRenamed("doc_id", "labelled_id"))
    return texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("text", "toxic")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n_toxic, n_clean): texts of each kind that hold each word, and each beginning."""
    for batch in slices(batches, most=HALF_BATCH_BYTES):
        words = Words(batch["text"], PUNCTUATION, lower=True)
        if not len(words):
            continue
        spelled = words.array().dictionary_encode()
        names = spelled.dictionary.cast(pa.binary()).cast(pa.string())
        text, numbers = words.text_of(), spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
        letters = pa.compute.utf8_length(names).to_numpy(zero_copy_only=False)
        for size in (None, *STEM_LETTERS):
            if size is None:
                terms, which, own = names, numbers, slice(None)
            else:
                begun = pa.compute.utf8_slice_codeunits(names, 0, size).dictionary_encode()
                terms = pa.compute.binary_join_element_wise(begun.dictionary, "*", "")
                long = letters[numbers] > size
                which, own = begun.indices.to_numpy(zero_copy_only=False).astype(np.int64)[numbers[long]], long
            pairs = np.unique(text[own] * len(terms) + which)
            kind = toxic[pairs // len(terms)] if len(pairs) else pairs
            sums = [np.bincount(pairs % len(terms), weights=w, minlength=len(terms)).astype(np.int64) for w in (kind, 1 - kind)]
            kept = pa.array(sums[0] + sums[1] > 0)
            columns = [terms, pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in columns], ["term", "n_toxic", "n_clean"])


def learn_lexicon(sample: DataFrame) -> list[str]:
    """All terms over-represented in toxic texts beyond chance, by the likelihood ratio against all
    words tested: the beginnings and words that ``chosen_terms`` keeps, then the words under these
    beginnings, whose misspellings the beginnings don't catch. They come to the driver; the sample
    bounds them."""
    sizes = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    n_toxic, n_clean = float(sizes["t"] or 0), float(sizes["c"] or 0)
    if not n_toxic or not n_clean:
        return []
    counts = sample.mapInArrow(_term_counts, "term string, n_toxic long, n_clean long").groupBy("term")
    counts = counts.agg(F.sum("n_toxic").alias("a"), F.sum("n_clean").alias("b"))
    a, b, total = F.col("a"), F.col("b"), n_toxic + n_clean

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (a + b) / F.lit(total)
    ratio = 2 * (
        part(a, share * n_toxic) + part(b, share * n_clean)
        + part(n_toxic - a, (1 - share) * n_toxic) + part(n_clean - b, (1 - share) * n_clean)
    )
    lift = ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))
    rated = counts.select("term", "a", "b", ratio.alias("ratio"), lift.alias("lift"))
    tested = sample.agg(F.sum(F.length("text")).alias("n")).first()["n"]  # more than there are terms
    strong = (F.col("a") >= LEAST_TEXTS) & (F.col("lift") >= 5) & (F.col("ratio") >= 2 * F.log(F.lit(float(tested))))
    best = [(r["term"], r["ratio"]) for r in rated.where(strong).orderBy(F.desc("ratio"), "term").collect()]
    return with_words(chosen_terms(best, len(best)), best)


def with_words(chosen: list[str], rated: list[tuple[str, float]]) -> list[str]:
    """The chosen terms, then all other whole words."""
    own = set(chosen)
    return chosen + [term for term, _ in rated if not term.endswith("*") and term not in own]


def chosen_terms(rated: list[tuple[str, float]], most: int) -> list[str]:
    """Of terms that say the same the best: a word before its beginnings, unless these are much
    better, and a beginning before the words and longer beginnings under it."""
    kept: list[str] = []
    begun, held = set(), set()  # kept beginnings, and all that kept terms begin with
    for term, _ in sorted(rated, key=lambda r: (-r[1] * (0.9 if r[0].endswith("*") else 1.0), r[0])):
        stem = term.removesuffix("*")
        begins = [stem[:k] for k in range(1, len(stem) + 1)]
        above = term.endswith("*") and stem in held
        if begun.isdisjoint(begins) and not above and len(kept) < most:
            kept.append(term)
            held.update(begins)
            if term.endswith("*"):
                begun.add(stem)
    return kept


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from the labelled sample, which is stored once. The driver gets the lexicon and five figures
    for each sampled text (``rows`` at most)."""
    sample = stored(labelled_sample(docs, labels, rows))
    terms = learn_lexicon(sample)
    lexicon = docs.sparkSession.sparkContext.broadcast(Lexicon(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HALF_BATCH_BYTES):
            values = features(lexicon.value, batch["text"])
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in values.T), batch["toxic"]], [*FEATURES, "toxic"])

    schema = ", ".join(f"{n} double" for n in FEATURES) + ", toxic int"
    found = sample.mapInArrow(run, schema).groupBy(*FEATURES, "toxic").count().orderBy(*FEATURES, "toxic").collect()
    discard(sample)
    many = [r["count"] for r in found]
    values = np.repeat(np.array([r[: len(FEATURES)] for r in found], float).reshape(-1, len(FEATURES)), many, axis=0)
    return Model(terms, logistic(values, np.repeat(np.array([r["toxic"] for r in found], float), many)))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs``, then toxic_score double and toxic_predicted int; one row per row.

    Null and empty texts are scored as texts without a hit. Names that ``docs`` has already get an
    underscore. The model (the terms that the sample gave) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    own = []
    for name in ("toxic_score", "toxic_predicted"):
        while name in docs.columns:
            name += "_"
        own.append(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HALF_BATCH_BYTES):
            score = shared.value.score(batch["text"])
            columns = [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *own])

    return docs.mapInArrow(run, f"{plain}, `{own[0]}` double, `{own[1]}` int")


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from ``labels`` that aren't held out.

    Rows with a null doc_id are scored and not held out. Repeated rows give repeated results; with
    no labels, or labels of one kind only, no term is learned and every text gets the share of
    toxic labels (little without any).
    """
    model = learn(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), model, threshold)
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic_predicted").alias("predicted"),
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic."""
    scored = score_documents(docs, learn(docs, labels), threshold)
    score, predicted = scored.columns[-2:]
    return scored.where(F.col(predicted) == 0).drop(score, predicted)
