"""Cases at the edges: marker words in names, equal phrases, gaps, wide vocabularies, hot pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.functions import tokens as K
from promptloom.functions.draws import sample_array, sort_keys
from promptloom.operators import corrupt as C, generate as G, probe as B, ranges as P, rewrite as W, runs as R, sampling as M
from promptloom.session import stored
from promptloom.sources import vocabulary as V

PROMPT = "### Instruction: show me the {} and {} from the {} table ### Context: CREATE TABLE {} ( {} INT, {} TEXT ) ### Response: "


def prompt(a, b, t):
    return PROMPT.format(a, b, t, t, a, b)


def test_names_with_marker_words_stay_whole(spark):
    rows = [(1, prompt("brand", "cost", "cars")), (2, prompt("thesis", "mandate", "selections"))]
    names = {1: ("brand", "cost", "cars"), 2: ("thesis", "mandate", "selections")}
    found = W.rewrite_prompts(spark.createDataFrame(rows, "item_id long, prompt string")).collect()
    said = {(r.item_id, r.kind): r.rewritten.split(" ### Context")[0].removeprefix("### Instruction: ") for r in found}
    for i, (a, b, t) in names.items():
        assert said[i, "SwapEng1"] == f"show me the {t} and {b} from the {a} table"
        assert said[i, "SwapEng2"] == f"show me the {a} and {t} from the {b} table"
        assert re.fullmatch(rf"show me the {a} and \w+ from the {t} table", said[i, "RandomEng2"])
        assert said[i, "FunctionWords"] == f"show me hit {a} under {b} sky hit {t} one"


def test_separator_sweep_tears_no_name(spark):
    df = spark.createDataFrame([(1, prompt("brand", "cost", "cars"))], "item_id long, prompt string")
    rows = {r.word: r.rewritten for r in W.sweep_prompts(df, "EngFieldSeparator").collect()}
    assert rows["$"].startswith("### Instruction: select the brand $ cost from") and "( brand INT" in rows["$"]
    assert rows["+"] == prompt("brand", "cost", "cars").replace("show me", "select").replace(" and ", " + ")


def test_second_phrase_is_edited_where_it_stands(spark):
    rows = C.corrupt_items(
        spark.range(400).withColumnRenamed("id", "item_id"),
        ("DefAggregateFunction1", "DefAggregateFunction2", "DefOrderByDirection2"), num_fields=4,
    ).collect()
    both = 0
    for r in rows:
        if r.feature_name == "DefOrderByDirection2":
            place = min(1, len(r.order_by) - 1)
            parts = r.corrupt_sql_statement.split("ORDER BY ")[1].split(", ")
            for k, (part, order) in enumerate(zip(parts, r.order_by)):
                turned = order["asc"] != (k == place)
                assert part == f"{order['name']} {'ASC' if turned else 'DESC'}"
            continue
        called = [f for f in r.select if f.aggregate]
        place = min(int(r.feature_name[-1]) - 1, len(called) - 1)
        both += len(called) > 1
        for k, f in enumerate(called):  # each phrase stands before its own field
            phrase = f"{r.agg_phrases[k]} {f.name}"
            assert phrase in r.english_prompt
            assert (phrase in r.corrupt_english_prompt) == (k != place), (phrase, r.corrupt_english_prompt)
    assert both > 50


def big_vocabulary(fields=50_000):
    return V.Vocabulary(
        fields=[(f"field_{k}", ["INTEGER", f"VARCHAR({k % 90 + 1})"][: 1 + k % 2], [f"word_{k}", f"other_{k}"]) for k in range(fields)],
        tables=[(f"table_{k}", [f"set_{k}"]) for k in range(2_000)],
    )


def test_large_vocabulary_is_no_part_of_the_plan(spark):
    vocab = big_vocabulary()
    ids = spark.range(300).withColumnRenamed("id", "item_id")
    for csn in (2, 5):
        items = G.generate_items(ids, csn, vocab=vocab, max_cols=6)
        plan = items._jdf.queryExecution().toString()
        assert len(plan) < 250_000 and "field_49" not in plan and "word_49" not in plan
    named = {n: (types, synonyms) for n, types, synonyms in vocab.fields}
    rows = items.select("table_fields", "table_name", "join_table").collect()
    fields = [f for r in rows for f in r.table_fields]
    assert all(f.type in named[f.name][0] and f.synonym in [s.replace("_", " ") for s in named[f.name][1]] for f in fields)
    assert len({f.name for f in fields}) > 900  # of some 1 200 draws
    assert all(len({f.name for f in r.table_fields}) == len(r.table_fields) for r in rows)
    pairs = C.corrupt_items(ids, ("DefJoinTable1",), vocab=vocab).select("clean_token", "corrupt_token").collect()
    assert pairs and all(r.clean_token != r.corrupt_token and r.corrupt_token.startswith("table_") for r in pairs)


def test_other_entry_is_even(spark):
    items = spark.range(6000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 2 == 0, "b").alias("used"))
    rows = C.other_entry(items, "other", ["a", "b", "a", "c", "d"], F.col("used"), 7, "s").groupBy("used", "other").count().collect()
    found = {(r.used, r.other): r["count"] for r in rows}
    assert set(found) == {("b", w) for w in "acd"} | {(None, w) for w in "abcd"}
    assert all(abs(n - 3000 / (3 if used else 4)) < 120 for (used, _), n in found.items())


def test_places_of_tokens(spark):
    texts = ["a b a , a b", "", "x", None, "a " * 3000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = {r.k: r.p for r in rows.select("k", K.places(K.word_tokens(F.col("t"))).alias("p")).collect()}
    assert found == {0: {"a": [0, 2, 4], "b": [1, 5], ",": [3]}, 1: {}, 2: {"x": [0]}, 3: {}, 4: {"a": list(range(3000))}}


def test_positions_of_stored_pairs_are_those_of_new_ones(spark):
    ids = spark.range(60).withColumnRenamed("id", "item_id")
    names = ("feature_name", "item_id", "prompt_token_index", "answer_token_index", "prompt_length")
    new = C.corrupt_positions(ids).select(*names)
    kept = C.with_token_positions(stored(C.corrupt_items(ids))).select(*names)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, kept.collect()))


def test_rotation_with_gaps(spark):
    rows = [(0, 1, "a"), (0, 2, "b"), (1, 0, "c"), (1, 2, "d"), (1, 7, None), (2, 5, "e")]
    df = spark.createDataFrame(rows, "batch int, place int, value string")
    found = {(r.batch, r.place): r.partner for r in R.rotated_partner(df, "batch", "place", "value").collect()}
    assert found == {(0, 1): "b", (0, 2): "a", (1, 0): "d", (1, 2): None, (1, 7): "c", (2, 5): "e"}


@pytest.fixture
def cut_finely(spark):
    """Many more ranges than groups, so that groups lie across ranges."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def grouped_rows(seed=3, count=900):
    draw = np.random.default_rng(seed)
    group = draw.choice([0, 0, 0, 0, 0, 0, 1, 2, 3], count).tolist()  # one group holds most rows
    group = [None if g == 2 else g for g in group] + [7, 8, 9]
    value = [None if v < 0.05 else round(v, 3) for v in draw.uniform(size=count).tolist()] + [0.5, None, 0.25]
    return [(g, int(k), v) for g, k, v in zip(group, draw.permutation(count + 3), value)]


def test_group_larger_than_a_range(spark, cut_finely):
    rows = grouped_rows()
    df = spark.createDataFrame(rows, "batch int, place int, value double")
    parts = P.ranged(df, "batch", "place").groupBy("_range").agg(F.count_distinct("batch").alias("n"), F.count("*").alias("rows")).collect()
    assert len(parts) > 15 and max(r["rows"] for r in parts) < 150  # no task sees the hot group
    sums, circle = {}, {}
    for g in {g for g, _, _ in rows}:
        own = sorted((k, v) for b, k, v in rows if b == g)
        total = 0.0
        for (k, v), (_, after) in zip(own, own[1:] + own[:1]):
            total += v or 0.0
            sums[g, k], circle[g, k] = total, after
    found = {(r.batch, r.place): r.total for r in P.running_sum(df.fillna(0.0, ["value"]), ["batch"], ["place"], "value", "total").collect()}
    assert found.keys() == sums.keys() and all(v == pytest.approx(sums[k]) for k, v in found.items())
    found = {(r.batch, r.place): r.partner for r in R.rotated_partner(df, "batch", "place", "value").collect()}
    assert found == circle
    assert P.running_sum(df.limit(0), ["batch"], ["place"], "value", "total").count() == 0
    assert R.rotated_partner(df.limit(0), "batch", "place", "value").count() == 0


def test_numbers_and_shuffle_places(spark, cut_finely):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    assert {(r.id, r.place) for r in P.numbered(df, ["id"]).collect()} == {(k, k) for k in range(1000)}
    places = {r.id: r.place for r in M.shuffled(df, "id", 5, place="place").collect()}
    in_order = [r.id for r in M.shuffled(df, "id", 5).collect()]
    assert [places[i] for i in in_order] == list(range(1000))


def test_important_heads_of_a_large_group(spark, cut_finely):
    draw = np.random.default_rng(4)
    rows = [(label, head, float(m)) for label in ("a", None) for head, m in enumerate(draw.integers(0, 50, 400))]
    rows += [("flat", 0, 1.0), ("flat", 1, 1.0)]
    df = spark.createDataFrame(rows, "label string, head int, magnitude double")
    found = {(r.label, r.head) for r in R.important_heads(df, 0.6, "label").collect()}
    kept = {("flat", 0), ("flat", 1)}
    for label in ("a", None):
        own = sorted((-m, h) for g, h, m in rows if g == label)
        least, total, so_far = -own[-1][0], sum(-m for m, _ in own) + len(own) * own[-1][0], 0.0
        for m, h in own:
            if so_far / total < 0.6 - 1e-12:
                kept.add((label, h))
            so_far += -m - least
    assert found == kept
    alone = df.where("label = 'a'").drop("label")
    assert {r.head for r in R.important_heads(alone, 0.6).collect()} == {h for g, h in kept if g == "a"}


def test_newton_probe_is_at_the_optimum(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(400, 3)) * (draw.uniform(size=(400, 3)) < 0.7)
    y = (draw.uniform(size=400) < 1 / (1 + np.exp(-(x @ [1.5, -1.0, 0.0] + 0.3)))).astype(int)
    rows = [(k, int(v), {f"f{j}": float(e) for j, e in enumerate(r) if e}) for k, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, label int, representation map<string,double>")
    index = B.feature_index(df)
    model = B.newton_probe(stored(B.feature_entries(df, index, "id", "label", 3)), 3)
    w = np.array([*model.weights, model.intercept])
    full = np.hstack([x, np.ones((400, 1))])
    slope = full.T @ (1 / (1 + np.exp(-full @ w)) - y) + w * [1, 1, 1, 0]
    assert np.abs(slope).max() < 1e-6 and w[0] > 0.8 and w[1] < -0.4


def test_more_than_a_thousand_elements(spark):
    n = 1200
    df = spark.range(3).withColumns(
        {"keys": sort_keys(7, F.col("id"), "wide", n), "values": F.sequence(F.lit(0), F.lit(n - 1))}
    )
    for r in df.select(sample_array(F.col("values"), F.col("keys"), F.lit(n)).alias("v")).collect():
        assert sorted(r.v) == list(range(n)) and r.v != sorted(r.v)


def test_hot_word_pair(spark):
    vectors = {"x": [1.0, 0.0], "y": [0.6, 0.8], "z": [0.0, 1.0]}
    outputs = spark.range(300).select(
        F.col("id").alias("item_id"), F.lit("x x z").alias("a"),
        F.when(F.col("id") % 3 == 0, "y x x").otherwise("y z").alias("b"),
    )
    frame = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    found = {r.item_id: r.similarity for r in W.output_similarity(outputs, frame, salts=5).collect()}
    assert len(found) == 300
    assert all(v == pytest.approx((0.6 + 1 + 0) / 3 if i % 3 == 0 else 0.3) for i, v in found.items())


def test_sanity_over_a_stored_table_of_pairs(spark):
    pairs = C.corrupt_items(spark.range(50).withColumnRenamed("id", "item_id"), ("DefTableName", "EngTableName"))
    kept = stored(pairs.select(*[c for c in pairs.columns if not c.startswith("changed_")]))
    assert C.sanity_violations(kept).count() == 0
    broken = kept.withColumn("corrupt_create_statement", F.col("create_statement"))
    assert C.sanity_violations(broken).select("feature_name").distinct().collect()[0][0] == "DefTableName"


def test_probe_learns_and_ranks(spark):
    draw = np.random.default_rng(1)
    rows = [
        (i, int(label), {"signal": float(2.0 * label + draw.normal(0, 0.1)), f"noise{draw.integers(40)}": 1.0})
        for i, label in enumerate(draw.integers(0, 2, 300))
    ]
    df = spark.createDataFrame(rows, "id long, label int, representation map<string,double>")
    probe = B.train_probe(df, "id", top_k=3)
    assert probe.accuracy.first()["accuracy"] > 0.95
    assert probe.top_features.orderBy(F.desc("importance")).first()["feature"] == "signal"
    index = B.feature_index(df).orderBy("idx").collect()
    assert [r.idx for r in index] == list(range(len(index))) and [r.feature for r in index] == sorted(r.feature for r in index)
