"""Jobs end to end: determinism, corruption invariants, run summaries, storage, streams."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from promptloom.functions import tokens as K
from promptloom.operators import (
    corrupt as C, dataset as DS, generate as G, profile as P, rewrite as W, runs as R,
    sampling as M, score as SC,
)
from promptloom.sources import corpus as D, vocabulary as V
from promptloom.streaming import jobs as ST


def ids(spark, n, parts=2):
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "item_id")


# -------------------------------------------------------------------------- generator
@pytest.mark.parametrize("csn", [1, 3, 5])
def test_items_do_not_depend_on_partitioning(spark, csn):
    def rows(parts):
        df = G.generate_items(ids(spark, 60, parts), csn, use_synonyms_field=True)
        return sorted(map(str, df.collect()))

    assert rows(1) == rows(7)


def test_item_shapes(spark):
    for csn in range(1, 6):
        for r in G.generate_range(spark, 40, csn, use_synonyms_table=True).collect():
            names = [f.name for f in r.table_fields]
            assert 2 <= len(names) <= 12 and len(set(names)) == len(names)
            assert r.create_statement.startswith(f"CREATE TABLE {r.table_name.name} ( {names[0]} ")
            assert {s.name for s in r.select} <= set(names)
            assert r.sql_statement.startswith("SELECT ")
            assert (r.order_by is None) == (csn == 1)
            assert r.command_set == (2 if csn == 3 else csn)
            if csn in (2, 3, 4):
                assert bool(r.order_by) == (r.item_id < 36)
                assert len({o.asc for o in r.order_by}) <= 1
            if csn == 5 and r.join_table:
                assert f"JOIN {r.join_table.name} ON {r.table_name.name}." in r.sql_statement


def test_unknown_command_set(spark):
    with pytest.raises(ValueError):
        G.generate_items(ids(spark, 1), 6)


def test_own_vocabulary_and_name_clash(spark):
    vocab = V.Vocabulary(
        fields=[(n, ["INTEGER"], [n + "_x"]) for n in ("users", "name", "size", "kind")],
        tables=[("users", ["user_list"])],
    )
    rows = G.generate_range(spark, 30, 1, vocab=vocab, min_cols=4, max_cols=4).collect()
    for r in rows:
        assert sorted(f.name for f in r.table_fields) == ["kind", "name", "size", "users_field"]
        assert r.table_name.synonym == "user list"


def test_vocabulary_sizes(spark):
    sizes = {r.vocabulary: r["size"] for r in V.vocabulary_sizes(spark).collect()}
    parts = [sizes[k] for k in ("fields", "tables", "select_templates", "order_phrases", "agg_phrases")]
    assert parts == [311, 304, 56, 72, 90]
    assert sizes["product"] == 311 * 304 * 56 * 72 * 90


# ------------------------------------------------------------------------- corruption
@pytest.mark.parametrize("feature", list(C.FEATURES))
def test_pairs_change_what_they_promise(spark, feature):
    pairs = C.with_token_positions(C.corrupt_items(ids(spark, 60), (feature,))).collect()
    assert len(pairs) > 20
    for r in pairs:
        assert r.clean_token != r.corrupt_token
        assert r[C.promise_of(feature)]
        assert r.prompt_token_index < r.answer_token_index or -1 in (
            r.prompt_token_index, r.answer_token_index,
        )


@pytest.mark.parametrize("feature", ["EngTableName", "DefTableName", "DefFieldName", "EngFieldName"])
def test_clean_token_stands_at_its_index(spark, feature):
    from promptloom.functions import text as T, tokens as K

    pairs = C.with_token_positions(C.corrupt_items(ids(spark, 50), (feature,), use_novel_names=True))
    prompt = T.prompt_text(F.col("english_prompt"), F.col("create_statement"))
    tokens = pairs.withColumn("toks", K.word_tokens(prompt))
    for r in tokens.collect():
        assert r.toks[r.prompt_token_index] == r.clean_token
        assert r.corrupt_token in (*V.PAIRS.novel_tables, *V.PAIRS.novel_fields)


def test_pairs_have_one_length(spark):
    lengths = C.length_check(C.corrupt_items(ids(spark, 80), tuple(list(C.FEATURES)[:6])))
    assert all(r.lengths == 1 for r in lengths.collect())


def test_unknown_feature(spark):
    with pytest.raises(ValueError):
        C.corrupt_items(ids(spark, 1), ("NoSuchFeature",))


# ---------------------------------------------------------------------- run summaries
def test_important_heads(spark):
    rows = spark.createDataFrame(
        [("x", i, m) for i, m in enumerate([5.0, 3.0, 2.0, 1.0])] + [("flat", i, 2.0) for i in range(3)],
        "g string, head int, magnitude double",
    )
    kept = R.important_heads(rows, 0.8, "g").collect()
    assert sorted(r.head for r in kept if r.g == "x") == [0, 1]
    assert sorted(round(r.cumulative, 6) for r in kept if r.g == "x") == [0.571429, 0.857143]
    assert sorted(r.head for r in kept if r.g == "flat") == [0, 1, 2]


def test_stopping_point(spark):
    curve = [0.5, 0.72, 0.73, 0.735, 0.74]
    rows = [("a", k + 1, s) for k, s in enumerate(curve)] + [("b", 1, 0.1), ("b", 2, 0.2)]
    df = spark.createDataFrame(rows, "experiment string, k int, similarity double")
    got = {r.experiment: (r.k, r.similarity, r.flattened) for r in R.stopping_point(df).collect()}
    assert got == {"a": (4, 0.735, True), "b": (2, 0.2, False)}


def test_edges(spark):
    rows = [(1, "x", "y", 0.4), (2, "x", "y", -0.2), (1, "y", "z", 0.9)]
    df = spark.createDataFrame(rows, "batch int, from_edge string, to_edge string, score double")
    (r,) = R.consistent_edges(df).collect()
    assert (r.from_edge, r.to_edge) == ("x", "y") and r.mean_score == pytest.approx(0.1)
    two = spark.createDataFrame([("x", "y", 0.5), ("y", "z", 0.25)], "from_edge string, to_edge string, score double")
    assert {r.node: r.node_score for r in R.node_scores(two).collect()} == {"x": 0.5, "y": 0.75, "z": 0.25}


def test_rotation_and_metric(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate("abc")], "batch int, place int, value string")
    got = R.rotated_partner(df, "batch", "place", "value").orderBy("place").collect()
    assert [r.partner for r in got] == ["b", "c", "a"]
    runs = spark.createDataFrame([(1, "patched", 1.0), (1, "corrupt", -1.0), (1, "clean", 3.0)], "l int, run string, logit_diff double")
    assert R.normalised_metric(runs, "l").first().metric == 0.5


def test_output_similarity(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("b", [0.0, 4.0])], "word string, vector array<double>")
    outputs = spark.createDataFrame([(1, "a a b", "a b"), (2, "", "a"), (3, "a z", "a y")], "item_id int, a string, b string")
    got = {r.item_id: r.similarity for r in W.output_similarity(outputs, W.word_vectors(vectors)).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.5}


# --------------------------------------------------------------------- samples, splits
@pytest.mark.parametrize("n", [1, 10, 37, 1000])
def test_exact_split_sizes(spark, n):
    import math

    got = {r.split: r["count"] for r in M.split_exact(ids(spark, n), "item_id").groupBy("split").count().collect()}
    test = math.ceil(n * 0.1)
    validation = math.ceil((n - test) * 0.15)
    expected = {"test": test, "validation": validation, "train": n - test - validation}
    assert got == {k: v for k, v in expected.items() if v}


def test_shuffle_is_seeded(spark):
    def order(parts, seed):
        return [r.item_id for r in M.shuffled(ids(spark, 50, parts), "item_id", seed).collect()]

    assert order(1, 7) == order(6, 7) != order(6, 8)
    assert sorted(order(3, 7)) == list(range(50)) != order(3, 7)


def test_samples(spark):
    df = ids(spark, 90).withColumn("g", F.col("item_id") % 3)
    assert M.sample_per_group(df, "g", "item_id", 5).groupBy("g").count().where("count <> 5").count() == 0
    assert M.sample_rows(df, "item_id", 7).count() == 7
    assert M.repeated(df, 6).count() == 540


def test_text_metrics(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat. It ran!"), (2, "")], "id int, t string")
    uni = P.unigram_counts(df, "t", 1)
    got = {r.id: r for r in P.text_metrics(df, "id", "t", uni).collect()}
    assert got[1].lexical_density == pytest.approx(4 / 8)
    assert got[1].readability == pytest.approx(206.835 - 1.015 * 4 - 84.6 * 8 / 8)
    assert got[2].lexical_density is None and got[2].rarity is None


# -------------------------------------------------------------------- storage, streams
def test_dataset_build(spark, tmp_path):
    path = str(tmp_path / "corpus")
    for csn in (1, 2, 3):
        check = DS.build_dataset(spark, path, f"cs{csn}", rows=40, csn=csn, use_synonyms=True).first()
        assert check.accuracy_pct == 100.0 and check.n == 30
    back = D.read_corpus(spark, path, "cs2", "test")
    assert back.count() == 4
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    orders = {r.dataset: r.n for r in spark.read.parquet(path).groupBy("dataset").agg(F.count("order_by").alias("n")).collect()}
    assert orders == {"cs1": 0, "cs2": 40, "cs3": 40}


def test_documents_round_trip(spark, tmp_path):
    doc = {"metadata": {"model": "m"}, "parameters": {"n": "2"}, "edges": [{"from_edge": "mlp.0", "to_edge": "head.1.2.q", "score": 0.123456789123}]}
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text(json.dumps(doc))
    read = D.read_documents(spark, str(path), D.EDGE_RESULT)
    rows = R.edges_of_documents(read).collect()
    assert [(r.from_edge, r.to_edge, r.score) for r in rows] == [("l0.mlp", "l1.h2.q", 0.12345679)]
    D.write_documents(read, str(tmp_path / "out"))
    assert D.read_documents(spark, str(tmp_path / "out"), D.EDGE_RESULT).collect() == read.collect()


def test_cached_result_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert D.cached_result(spark, str(tmp_path), "x", {"a": 1}, build).count() == 3
    D.cached_result(spark, str(tmp_path), "x", {"a": 2}, build)
    assert len(calls) == 2


def test_score_stream_equals_batch(spark, tmp_path):
    items = G.generate_range(spark, 20, 2)
    preds = SC.perturbed_predictions(items)
    columns = [*[c for c in SC.ITEM_INPUT if c != "command_set"], "kind", "generated"]
    rows = items.join(preds, "item_id").select(*columns)
    rows.write.parquet(str(tmp_path / "in"))
    query = ST.score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), f"score-{uuid.uuid4().hex}")
    query.awaitTermination(120)
    streamed = {r.item_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.item_id: r.score for r in SC.score_predictions(items, preds).collect()}
    assert streamed == batch


def test_rewrite_stream_equals_batch(spark, tmp_path):
    from promptloom.functions import text as T

    base = C.make_base_items(ids(spark, 10))
    prompts = base.select("item_id", T.prompt_text(F.col("english_prompt"), F.col("create_statement")).alias("prompt"))
    prompts.write.parquet(str(tmp_path / "in"))
    query = ST.rewrite_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), f"rewrite-{uuid.uuid4().hex}", ("SwapEng1",))
    query.awaitTermination(120)
    streamed = sorted(r.rewritten for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert streamed == sorted(r.rewritten for r in W.rewrite_prompts(prompts, ("SwapEng1",)).collect())


def test_prefixes_of_long_and_odd_rows(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["x"]), (5, ["y", None])]
    df = spark.createDataFrame(rows, "k int, toks array<string>")
    found = sorted(map(tuple, K.prefixes(df, "toks", "k").collect()))
    assert found == [(1, 1, ["a"], "b"), (1, 2, ["a", "b"], "a"), (5, 1, ["y"], None)]
    # All prefixes of a row at once would be 72 million tokens.
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(12_000)), lambda k: k.cast("string")).alias("toks"))
    row = K.prefixes(long, "toks").agg(F.count("*").alias("n"), F.sum(F.size("prefix")).alias("tokens")).first()
    assert (row.n, row.tokens) == (11_999, 11_999 * 12_000 // 2)
