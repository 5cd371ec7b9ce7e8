"""Lifetime of stored tables, cached results with several builders, bucketed joins."""

import glob
import threading
import time

import pytest
from pyspark.sql import functions as F

from promptloom import session as SS
from promptloom.operators import score as SC
from promptloom.plans import CHECKS
from promptloom.plans.scores import stored_items
from promptloom.sources import corpus as D


def folders(spark):
    return set(glob.glob(SS.shared_folder(spark).removeprefix("file:") + "/stored-*"))


def swept(spark, before):
    """Sweep until the folders of before are left; the JVM may need a moment."""
    for _ in range(20):
        SS.sweep(spark, collect=True)
        if folders(spark) <= before:
            return True
        time.sleep(0.2)
    return False


def test_stored_tables_go_with_their_readers(spark):
    before = folders(spark)
    table = SS.stored(spark.range(100).withColumn("x", F.col("id") * 2))
    path = (folders(spark) - before).pop()
    derived = table.where("x > 10").groupBy().agg(F.sum("x").alias("s"))
    other = SS.reread(table, "id long")
    del table
    assert not swept(spark, before) and path in folders(spark)  # two still read it
    assert derived.first()["s"] == sum(range(12, 200, 2))
    del derived
    assert not swept(spark, before) and other.count() == 100
    del other
    assert swept(spark, before)


def test_nothing_of_a_query_is_left(spark, sf, tmp_path):
    before = folders(spark)
    for name in ("error_detection_probe", "rotated_partners", "important_heads", "feature_index"):
        df = CHECKS[name].run(spark, sf)
        df.write.parquet(str(tmp_path / name))
        del df
        assert swept(spark, before), name


def test_discard_takes_stored_tables_only(spark, sf):
    with pytest.raises(ValueError):
        SS.discard(spark.read.parquet(f"{sf}/nation.parquet"))
    SS.discard(SS.stored(spark.range(3).where("id > 5")))


def test_two_builders_and_a_reader(spark, tmp_path):
    folder, built, counts, errors = str(tmp_path / "cache"), [], [], []
    started = threading.Barrier(2)

    def builder(k):
        def build():
            started.wait(60)  # both are building before either has finished
            built.append(k)
            return spark.range(5000).withColumn("by", F.lit(k))

        try:
            rows = D.cached_result(spark, folder, "slow", {"n": 1}, build)
            counts.append((rows.count(), rows.agg(F.count_distinct("by")).first()[0], rows.first()["by"]))
        except Exception as error:  # for the main thread
            errors.append(error)

    def reader():
        seen = 0
        while seen < 5 and not errors:
            found = [p for p in glob.glob(folder + "/slow-*")]
            if found:
                seen += 1
                if spark.read.parquet(found[0]).count() != 5000:
                    errors.append(AssertionError("a part of a result was read"))
            time.sleep(0.05)

    threads = [threading.Thread(target=builder, args=(k,)) for k in (1, 2)] + [threading.Thread(target=reader)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not errors and sorted(built) == [1, 2]
    assert counts[0] == counts[1] and counts[0][:2] == (5000, 1)  # one builder's result, whole
    assert len(glob.glob(folder + "/*")) == 1  # and nothing of the other's

    def never():
        raise AssertionError("built again")

    assert D.cached_result(spark, folder, "slow", {"n": 1}, never).count() == 5000
    assert D.cached_result(spark, folder, "slow", {"n": 2}, lambda: spark.range(7)).count() == 7


def test_eviction_by_age(spark, tmp_path):
    folder = str(tmp_path / "cache")
    for n in (1, 2):
        D.cached_result(spark, folder, "r", {"n": n}, lambda: spark.range(3))
    time.sleep(1.5)
    D.cached_result(spark, folder, "r", {"n": 2}, lambda: spark.range(4))  # renews its age
    assert len(D.evict(spark, folder, 1.2)) == 1 and len(glob.glob(folder + "/*")) == 1
    assert D.cached_result(spark, folder, "r", {"n": 2}, lambda: spark.range(4)).count() == 3
    assert D.evict(spark, str(tmp_path / "nowhere"), 0) == []


def test_bucketed_tables_join_without_a_shuffle(spark, sf, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = stored_items(spark, sf, 2)
        predictions = D.write_bucketed(SC.perturbed_predictions(items), str(tmp_path / "predictions"), "item_id", 8)
        again = D.read_bucketed(spark, str(tmp_path / "predictions"), "item_id", 8, "item_id bigint, kind string, generated string")
        for own in (predictions, again):
            scored = SC.score_predictions(items, own).select("item_id", "kind", "score")
            assert scored.where("kind = 'exact' AND score < 1").count() == 0
            scored.collect()
            plan = scored._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        loose = spark.read.parquet(str(tmp_path / "predictions"))  # predictions that come unsorted
        plan = SC.score_predictions(items, loose)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1  # theirs; the items stay where they are
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
