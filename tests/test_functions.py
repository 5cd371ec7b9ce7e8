"""Worked values of single expressions."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from promptloom.functions import draws as D, rewriting as R, similarity as M, text as T, tokens as K
from promptloom.functions.vectors import cosine, round_nested


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(text):
    return F.lit(text)


def test_text(spark):
    assert value(spark, T.squish(lit(" a\n  b "))) == "a b"
    assert value(spark, T.squish(lit("a  b\x1c c"))) == "a b c"
    sql = lit("SELECT a FROM t WHERE a = 1")
    assert value(spark, T.replace_first_after(sql, "WHERE", lit("a"), lit("b"))) == "SELECT a FROM t WHERE b = 1"
    assert value(spark, T.replace_first_after(lit("x a"), "WHERE", lit("a"), lit("b"))) == "x a"
    assert value(spark, T.replace_first(lit("a.c abc"), lit("a.c"), lit("$1\\"))) == "$1\\ abc"
    assert value(spark, T.base_type(lit("varchar(50)"))) == "VARCHAR"
    assert value(spark, T.no_punctuation(lit("a,b-c_d"))) == "a b c d"
    assert value(spark, T.words_of(lit("Élan d'été, x_1!"))) == ["élan", "d", "été", "x_1"]


@pytest.mark.parametrize(
    "name,renamed,layer",
    [("mlp.3", "l3.mlp", 3), ("head.1.4.q", "l1.h4.q", 1), ("head.0.2", "l0.h2", 0), ("out", "out", 0)],
)
def test_node_names(spark, name, renamed, layer):
    assert value(spark, T.rename_node(lit(name))) == renamed
    assert value(spark, T.layer_of(lit(name))) == layer


def test_prompt_parts(spark):
    prompt = T.prompt_text(lit("show  me"), lit("CREATE TABLE t ( a INT )"))
    assert value(spark, prompt) == "### Instruction: show me ### Context: CREATE TABLE t ( a INT ) ### Response: "
    assert value(spark, T.answer_part(lit("x ### Response: SELECT a"))) == "SELECT a"
    assert value(spark, T.answer_part(lit("no mark"))) is None
    assert value(spark, T.table_names_of(lit("create table B ( x ) from a"))) == ["a", "b"]


def test_draw_values(spark):
    rows = spark.range(3).select(D.draw(7, F.col("id"), "tbl").alias("v")).collect()
    assert [r.v for r in rows] == [451478628, 3510368543, 3996756592]


@pytest.mark.parametrize("n", [1, 2, 12, 18, 311])
def test_sampled_indices_differ(spark, n):
    take = min(n, 12)
    start, step = D.sample_start(n, 3, "id", "s")
    drawn = spark.range(200).select(start.alias("start"), step.alias("step"))
    picked = D.sample_indices(n, F.lit(take), F.col("start"), F.col("step"))
    for row in drawn.select(picked.alias("v")).collect():
        assert len(set(row.v)) == take and all(0 <= i < n for i in row.v)


def test_sample_array_is_uniform(spark):
    values = F.array(*[F.lit(i) for i in range(5)])
    keyed = spark.range(20000).withColumn("keys", D.sort_keys(3, F.col("id"), "s", 5))
    picked = D.sample_array(values, F.col("keys"), F.lit(2))
    rows = keyed.select(F.explode(picked).alias("v")).groupBy("v").count().collect()
    assert all(abs(r["count"] - 8000) < 400 for r in rows)


# ------------------------------------------------------------------------ similarity
def reference_columns(text):
    part = text[text.find("SELECT") + 7 : text.find("FROM")].strip()
    return [c.strip() for c in part.split(",")]


def test_similarity_values(spark):
    a, b = lit("SELECT a, b FROM t"), lit("SELECT a, c FROM t")
    assert value(spark, M.five_point_similarity(a, b)) == pytest.approx(0.8)
    a, b = lit("SELECT a, b FROM t ORDER BY a ASC"), lit("SELECT a, b FROM t ORDER BY a DESC")
    assert value(spark, M.eight_point_similarity(a, b)) == pytest.approx(0.875)
    assert value(spark, M.clause_similarity(a, b)) == pytest.approx(8 / 11)


WORDS = st.lists(
    st.sampled_from(["SELECT", "FROM", "ORDER BY", "a", "b", "t", "AS", "ASC", ",", "x_AS"]), max_size=9
).map(" ".join)


@settings(max_examples=3, deadline=None)
@given(st.lists(WORDS, min_size=40, max_size=40))
def test_select_list_slicing(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.c for r in rows.select("id", M._columns(F.col("t")).alias("c")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == reference_columns(text), text


def test_vectors(spark):
    a, b = F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(1.0))
    assert value(spark, cosine(a, b)) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, cosine(a, F.array(lit(0.0), lit(0.0)))) is None
    assert value(spark, round_nested(F.array(F.array(lit(0.123456789123))), 8, 2)) == [[0.12345679]]


# ---------------------------------------------------------------------------- tokens
def test_positions(spark):
    tokens = T.blank_words(lit("a b a c b a"))
    assert value(spark, K.occurrence(tokens, lit("a"))) == 0
    assert value(spark, K.occurrence(tokens, lit("a"), 2)) == 2
    assert value(spark, K.occurrence(tokens, lit("z"), 2)) == -1
    assert value(spark, K.position_after(tokens, lit("c"), lit("a"))) == 5
    assert value(spark, K.position_after(tokens, lit("z"), lit("a"))) is None


@pytest.mark.parametrize("p,r,max_len", [(3, 2, 10), (9, 2, 8), (2, 9, 6), (0, 1, 3)])
def test_training_row(spark, p, r, max_len):
    prompt, response = list(range(1, p + 1)), list(range(101, 101 + r))

    def arr(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<int>")

    got = value(spark, K.training_row(arr(prompt), arr(response), end=99, pad=0, max_len=max_len))
    answer = (response + [99])[:max_len]
    kept = prompt[: max(max_len - len(answer), 0)]
    fill = max_len - len(kept) - len(answer)
    assert got.input_ids == kept + answer + [0] * fill
    assert got.labels == [-100] * len(kept) + answer + [-100] * fill
    assert got.attention_mask == [1] * (len(kept) + len(answer)) + [0] * fill


def test_model_tokenizer_plugs_in(spark):
    def encode(texts):
        return [[len(w) for w in t.split()] for t in texts]

    rows = spark.createDataFrame([("ab c",), (None,)], "t string").select(K.model_tokens(encode)("t").alias("v"))
    assert [r.v for r in rows.collect()] == [[2, 1], []]
    first = K.first_token_id(encode)(F.lit("word"))
    assert value(spark, first) == 4


# -------------------------------------------------------------------------- rewrites
PROMPT = (
    "### Instruction: show me the cost and city from the books table ### Context: "
    "CREATE TABLE books ( cost INT, city TEXT ) ### Response: "
)


def test_swaps(spark):
    t = lit(PROMPT)
    kinds = R.rewrites(7, F.lit(1))
    got = {k: value(spark, f(t)) for k, f in kinds.items()}
    assert got["SwapEng1"].startswith("### Instruction: show me the books and city from the cost table")
    assert got["SwapEng2"].startswith("### Instruction: show me the cost and books from the city table")
    assert "CREATE TABLE cost ( books INT, city TEXT )" in got["SwapCreate1"]
    assert "CREATE TABLE city ( cost INT, books TEXT )" in got["SwapCreate2"]
    assert got["FunctionWords"].startswith("### Instruction: show me hit cost under city sky hit books one")
    assert "CREATE TABLE books ( cost INT, city TEXT )" in got["FunctionWords"]
    for name in ("RandomEng1", "RandomEng2", "RandomCreate1", "RandomCreate2"):
        assert got[name] != PROMPT and got[name].endswith("### Response: ")


def test_rewrites_without_pattern(spark):
    kinds = R.rewrites(7, F.lit(1))
    got = {k: value(spark, f(lit("nothing here"))) for k, f in kinds.items()}
    assert got["SwapEng1"] is None and got["SwapEng2"] is None
    assert all(got[k] == "nothing here" for k in got if not k.startswith("SwapEng"))
