"""What plans may and may not repeat."""

from pyspark.sql import functions as F

from promptloom.functions.draws import numbers, with_computed
from promptloom.functions.text import BLANKS
from promptloom.operators import corrupt as C
from promptloom.operators.generate import generate_items


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unread_draws_are_left_out(spark):
    plan = plan_of(generate_items(spark.range(5).withColumnRenamed("id", "item_id"), 3).select("item_id"))
    assert "md5" not in plan


def test_filters_do_not_repeat_a_computed_column(spark):
    df = with_computed(spark.range(5), {"word": F.md5(F.col("id").cast("string"))}).where("word > 'a' AND word < 'c'")
    assert plan_of(df).count("md5(") == 1
    assert df.count() == sum(1 for r in spark.range(5).select(F.md5(F.col("id").cast("string"))).collect() if "a" < r[0] < "c")


def test_many_draws_are_no_single_method(spark):
    df = spark.range(3).withColumnRenamed("id", "item_id").select(numbers(7, "item_id", "slot", 12).alias("n"))
    plan = plan_of(df)
    assert not any(line.lstrip(" +-:").startswith("*") and "md5" in line for line in plan.splitlines())
    assert [len(r.n) for r in df.collect()] == [12] * 3


def test_violations_are_counted_in_one_pass(spark):
    rows = C.corrupt_candidates(spark.range(20).withColumnRenamed("id", "item_id"), ("DefWhereField1", "EngTableName"))
    counts = C.violation_counts(rows)
    assert plan_of(counts).count("Range (") == plan_of(rows).count("Range (")
    bad = {r.feature_name: r["count"] for r in C.sanity_violations(rows).groupBy("feature_name").count().collect()}
    every = {r.feature_name: r["count"] for r in rows.groupBy("feature_name").count().collect()}
    assert {r.feature_name: (r.violations, r.candidates) for r in counts.collect()} == {
        name: (bad.get(name, 0), n) for name, n in every.items()
    }


def test_edits_are_columns_before_they_become_rows(spark):
    rows = C.corrupt_candidates(spark.range(5).withColumnRenamed("id", "item_id"), ("DefTableName", "DefFieldName"))
    generators = [line for line in plan_of(rows).splitlines() if "Generate inline(" in line]
    assert generators and all("md5" not in line and "replace(" not in line for line in generators)


def test_prepared_prompts_give_the_same_lengths_and_views(spark):
    ids, features = spark.range(30).withColumnRenamed("id", "item_id"), ("EngTableName", "DefFieldName", "DefWhereField1")
    pairs = C.corrupt_items(ids, features)
    for job, prepare in ((C.length_check, C.with_clean_length), (C.both_views, C.with_clean_prompt)):
        once = job(C.corrupt_items(ids, features, prepare=prepare)).collect()
        assert sorted(once) == sorted(job(pairs).collect()) and once


def test_blanks_are_the_listed_ones(spark):
    blanks = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
    every = spark.createDataFrame([(chr(c),) for c in range(1, 0x3100)], "c string")
    assert every.where(F.regexp_replace("c", blanks, "#") != F.regexp_replace("c", BLANKS, "#")).isEmpty()
    # a visible character is ruled out first
    assert BLANKS.startswith("[[^!-~]&&")


def test_command_sets_share_one_pass(spark):
    """Queries over several sets, or several columns of one set, read and make their items once."""
    from promptloom.plans import CHECKS

    for name in ("clause_shares", "vocabulary_coverage", "mean_scores", "error_partition", "ground_truth_check"):
        plan = CHECKS[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("o_orderkey#") and plan.count("Relation [o_orderkey") == 1, name


def test_sets_made_together_are_the_sets_made_alone(spark):
    from promptloom.operators import generate as G

    ids = spark.range(60).withColumnRenamed("id", "item_id")
    options = {"use_synonyms_table": True, "use_synonyms_field": True, "use_aggregates": True, "total": 60}
    together = G.generate_sets(ids, (1, 2, 3, 4, 5), **options)
    for csn in range(1, 6):
        alone = G.generate_items(ids, csn, **options)
        own = together.where(f"source_csn = {csn}").select(*alone.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, alone.collect()))


def test_numbers_nobody_reads_are_not_drawn(spark):
    from promptloom.functions import draws as D

    ids = spark.range(9).selectExpr("id AS item_id", "cast(id AS int) AS n").withColumns(D.block_columns(7, "item_id", "s", 9))
    both = ids.select("n", D.numbers(7, "item_id", "s", 9, "n").alias("some"), D.numbers(7, "item_id", "s", 9).alias("every"))
    for row in both.collect():
        assert row.some == row.every[: row.n] + [None] * (9 - row.n)


def test_flat_round_trip_makes_items_once(spark, sf):
    from promptloom.plans import CHECKS

    df = CHECKS["flat_round_trip"].run(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "from_json" in plan
