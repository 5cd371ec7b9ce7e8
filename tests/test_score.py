"""Score fixtures worked out by hand, and the invariants over random items."""

import pytest
from pyspark.sql import functions as F

from promptloom.operators import generate as G, score as SC
from promptloom.sources import schemas as S

ITEMS = {
    1: ([("price", ""), ("count", "")], None, "SELECT price, count FROM orders"),
    2: ([("price", ""), ("count", "")], [("price", False)],
        "SELECT price, count FROM orders ORDER BY price DESC"),
    3: ([("price", "SUM"), ("count", "")], [],
        "SELECT SUM(price) AS SUM_price, count FROM orders "),
}
CASES = [
    (1, ITEMS[1][2], 30, 30),
    (1, "select price,  count\nfrom orders", 30, 30),
    (1, "", 0, 0),
    (1, "SELECT price FROM orders", 29, 30),
    (1, ITEMS[1][2] + " please now", 16, 30),
    (1, "price count", 22, 26),
    (1, "SELECT price,count FROM orders;", 22, 29),
    (2, ITEMS[2][2], 42, 42),
    (2, "SELECT price, count FROM orders", 30, 30),
    (2, ITEMS[2][2] + " " + ITEMS[2][2], 36, 42),
    (2, "SELECT price, count FROM orders ORDER BY count ASC", 39, 42),
    (3, ITEMS[3][2], 31, 31),
    (3, "SELECT price, count FROM orders", 27, 31),
    (3, "SELECT MAX(price) AS MAX_price, count FROM orders", 25, 31),
    (4, "SELECT price FROM orders", 0, 0),
]


def test_worked_scores(spark):
    rows = []
    for i, (csn, text, _, _) in enumerate(CASES):
        select, order, sql = ITEMS.get(csn, ITEMS[1])
        rows.append((
            i, csn, ("orders", None, False), [(n, a, None, False) for n, a in select],
            order, sql, None, None, text,
        ))
    df = spark.createDataFrame(
        rows,
        f"item_id long, source_csn int, table_name {S.TABLE}, select array<{S.SELECT}>, "
        f"order_by array<{S.ORDER}>, sql_statement string, where array<string>, "
        f"join_table {S.TABLE}, generated string",
    )
    got = {r.item_id: (r.earned, r.possible, r.score) for r in SC.score_rows(df).collect()}
    for i, (_, _, earned, possible) in enumerate(CASES):
        assert got[i][:2] == (earned, possible), CASES[i]
        assert got[i][2] == pytest.approx(earned / possible if possible else 0.0)


@pytest.mark.parametrize("csn", [1, 2, 3])
def test_ground_truth_scores_one(spark, csn):
    items = G.generate_range(spark, 3000, csn, use_synonyms_table=True, use_synonyms_field=True)
    assert SC.below_full_score(SC.self_scores(items)).count() == 0


@pytest.mark.parametrize(
    "csn,kind,ceiling",
    [(1, "noise_after", 0.9), (1, "noise_before", 0.9), (2, "noise_after", 0.9),
     (3, "noise_after", 0.91), (3, "noise_before", 0.91), (1, "duplicate", 0.9),
     (2, "duplicate", 0.92), (3, "duplicate", 0.982), (3, "json_like", 0.98)],
)
def test_perturbed_answers_stay_below(spark, csn, kind, ceiling):
    items = G.generate_range(spark, 500, csn)
    scored = SC.score_predictions(items, SC.perturbed_predictions(items, (kind,)))
    assert scored.agg(F.max("score")).first()[0] < ceiling


def test_missing_prediction_scores_zero(spark):
    items = G.generate_range(spark, 4, 1)
    preds = SC.perturbed_predictions(items).where("item_id < 2")
    got = {r.item_id: r.score for r in SC.score_predictions(items, preds).collect()}
    assert got[2] == 0.0 and got[3] == 0.0 and got[0] == 1.0
