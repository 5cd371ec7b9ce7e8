import random

import pytest
from pyspark.sql import types as T

from promptloom.session import local_session

# Extra columns whose names clash with those of results.
DOCUMENT_TYPE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.StringType()),
        T.StructField("items", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    return local_session("tests", spark__checkpoint__dir=folder)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def table(session, rows):
    """Documents of (doc_id, text) with nulls and clashing names in the other columns."""
    full = [(i, t, None, "s", None if t is None else len(t), 0.5, 7, "x", None) for i, t in rows]
    return session.createDataFrame(full, DOCUMENT_TYPE)


def nasty_texts(seed=0, count=60, words=("a", "b", "The", "the", "ÄB", "é", "x1", "-", "’", "of")):
    """Random texts over few words: many repeats, copies, nulls, empty and long texts."""
    draw = random.Random(seed)
    texts = [None, "", " ", "\n\t", "one", "One", "one two three", "\x00", "é" * 3]
    for _ in range(count):
        texts.append(draw.choice([" ", "  ", "\n"]).join(draw.choices(words, k=draw.randint(0, 60))))
    texts += [draw.choice(texts) for _ in range(15)]
    texts.append(" ".join(draw.choices(words, k=6000)))
    texts.append("a " * 500)
    texts.append("q" * 30000)
    return texts


@pytest.fixture(scope="session")
def nasty(spark):
    rows = list(enumerate(nasty_texts()))
    rows += [rows[20], rows[21], (500, None)]
    return rows


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)

