import hashlib
import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from promptloom.llm import bpe
from promptloom.llm.queries import QUERIES

from .conftest import rows_of, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = (
    "a b the 's 're 'll 'x ' '' é ß 中 文 １ ½ ² \x1c \x1f \x00 😀 👨‍👩‍👧 <|endoftext|> <|endof !! - 9 123 ́ ST 'S ª ǅ ـ ﻿ ٣ Ⅷ 𝔘 aaaaaaaaa"
).split(" ") + [" ", "  ", "\n", "\t", "\r\n", "\u0085", " ", "　", "​", "᠎"]


def by_library(texts):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    found = library.encode_batch(texts, add_special_tokens=False)
    return [(f.ids, library.decode(f.ids, skip_special_tokens=False)) for f in found]


def test_random_texts_as_the_library():
    draw = random.Random(3)
    texts = ["".join(draw.choices(SIGNS, k=draw.randint(0, 14))) for _ in range(4000)]
    encoder = bpe.Encoder(bpe.read_vocabulary(PATH))
    ours = bpe.encode_batch(encoder, pa.array(texts))
    for text, (count, ids, raw), (want, decoded) in zip(texts, ours, by_library(texts)):
        assert (count, ids, bpe.decode(raw)) == (len(want), ",".join(map(str, want)), decoded), text


def test_results_do_not_depend_on_the_caches(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 3)
    text = "unbelievable unbelievably tokenization " * 20 + "z" * 5000
    encoder = bpe.Encoder(bpe.read_vocabulary(PATH))
    ((count, ids, raw),) = bpe.encode_batch(encoder, pa.array([text]))
    assert ids == ",".join(map(str, by_library([text])[0][0])) and bpe.decode(raw) == text


def digest(rows):
    found = []
    for (i, _), (ids, decoded) in zip(rows, by_library([t or "" for _, t in rows])):
        joined = ",".join(map(str, ids))
        found.append((i, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(found, key=repr)


def test_documents(spark, nasty, sf):
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(bpe.encode_documents(table(spark, nasty), PATH), *names) == digest(nasty)
    assert bpe.encode_documents(table(spark, []), PATH).count() == 0
    stored = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op10_bpe"](spark, sf), *names) == digest(stored)


def test_ids_and_text(spark):
    rows = bpe.encode_documents(table(spark, [(1, "Hello there"), (2, None)]), PATH, with_ids=True).orderBy("doc_id").collect()
    assert rows[0].ids == by_library(["Hello there"])[0][0] and rows[0].decoded == "Hello there"
    assert rows[1].ids == [] and rows[1].decoded == ""


def test_batches_are_bounded_in_bytes(monkeypatch):
    texts = ["word " * 60_000] * 20 + ["a" * 3_000_000, None, "b"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    seen = []
    monkeypatch.setattr(bpe, "encode_batch", lambda encoder, some: seen.append(some) or [(0, "", b"")] * len(some))
    rows = [i for part, done in bpe.encoded(None, [batch]) for i, _ in zip(part["doc_id"].to_pylist(), done)]
    assert rows == list(range(len(texts)))
    assert all(len(some) == 1 or sum(len(t or "") for t in some.to_pylist()) <= 2 << 20 for some in seen)
