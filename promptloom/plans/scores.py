"""Check queries of the scorers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from promptloom.operators import generate as G, score as SC
from promptloom.operators.dataset import checked_set
from promptloom.plans.base import ITEM_OPTIONS, check, items, order_ids, r6
from promptloom.plans.oracle.items import items_ctes
from promptloom.plans.oracle.scores import score_ctes
from promptloom.session import delete_on_exit, shared_folder
from promptloom.sources.corpus import write_bucketed

SYN = {"syn_table": True, "syn_field": True}
ALL_KINDS = (*SC.KINDS, "noise_before", "empty")


_STORED: dict[tuple, DataFrame] = {}


def stored_items(spark, sf, csn):
    """The items of a set, made once a session and stored by buckets of their id."""
    app = spark.sparkContext.applicationId
    if _STORED and next(iter(_STORED))[0] != app:
        _STORED.clear()
    if (app, sf, csn) not in _STORED:
        path = f"{shared_folder(spark)}/items-{app}-{csn}-{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        kept = items(spark, sf, csn).select(*SC.ITEM_INPUT)
        _STORED[app, sf, csn] = write_bucketed(kept, path, "item_id", buckets)
        delete_on_exit(spark, path)
    return _STORED[app, sf, csn]


def scored(spark, sf, csn, kinds=ALL_KINDS):
    """Scores of predictions that stand in a table of their own, joined to stored items."""
    df = stored_items(spark, sf, csn)
    return SC.score_predictions(df, SC.perturbed_predictions(df, kinds))


def scored_in_place(spark, sf, csn, kinds=ALL_KINDS):
    """Scores of predictions that sit in the item's row: map-only."""
    df = items(spark, sf, csn).select(*SC.ITEM_INPUT)
    return SC.score_rows(SC.with_perturbed(df, kinds))


def scored_sql(csn, kinds=ALL_KINDS, name="scored") -> str:
    return (
        items_ctes(csn, **SYN, name=f"items{csn}")
        + ", "
        + score_ctes(csn, kinds, f"items{csn}", name)
    )


def _scores(csn: int, covers: str):
    @check(
        f"scores_cs{csn}",
        covers,
        lambda: "WITH "
        + scored_sql(csn)
        + " SELECT item_id, kind, earned, possible, round(score, 6) AS score, "
        "round(strict_score, 6) AS strict_score, exact FROM scored",
    )
    def run(spark, sf):
        return scored(spark, sf, csn).select(
            "item_id", "kind", "earned", "possible", r6(F.col("score")).alias("score"),
            r6(F.col("strict_score")).alias("strict_score"), "exact",
        )


_scores(1, "C1 C2 C3 C4 C5 C6 C12 J2 F3")
_scores(2, "C1 C2 C3 C7 C8 C12 J2 F3")
_scores(3, "C1 C2 C3 C9 C10 C12 J2 F3")
_scores(4, "C11 C12 J2")
_scores(5, "C11 C12 J2")


def _three(spark, sf):
    made = G.generate_sets(order_ids(spark, sf), (1, 2, 3), columns=SC.ITEM_INPUT, **ITEM_OPTIONS)
    return SC.score_rows(SC.with_perturbed(made, ALL_KINDS))


def _three_sql() -> str:
    ctes = ", ".join(scored_sql(c, name=f"s{c}") for c in (1, 2, 3))
    rows = " UNION ALL ".join(
        f"SELECT item_id, source_csn, command_set, kind, generated, sql_statement, score, exact FROM s{c}"
        for c in (1, 2, 3)
    )
    return f"WITH {ctes}, scored AS ({rows}) "


@check(
    "mean_scores",
    "A1 A4",
    lambda: _three_sql()
    + "SELECT source_csn, command_set, kind, count(*) AS n, round(avg(score), 6) AS mean_score, "
    "round(avg(exact), 6) AS exact_share FROM scored GROUP BY ALL",
)
def mean_scores(spark, sf):
    means = SC.mean_scores(_three(spark, sf), "source_csn", "command_set", "kind")
    return means.withColumns(
        {"mean_score": r6("mean_score"), "exact_share": r6("exact_share")}
    )


@check(
    "evaluation_summary",
    "A2",
    lambda: "WITH "
    + scored_sql(2)
    + " SELECT count(*) AS n, round(avg((score = 1.0)::INT) * 100, 6) AS full_score_pct, "
    "round(avg(score) * 100, 6) AS mean_score_pct, 100.0::DOUBLE AS truth_score_pct FROM scored",
)
def evaluation_summary(spark, sf):
    summary = SC.evaluation_summary(SC.with_truth_score(scored_in_place(spark, sf, 2)))
    return summary.select("n", *[r6(c).alias(c) for c in summary.columns if c.endswith("_pct")])


@check(
    "ground_truth_check",
    "A3 X1",
    "SELECT * FROM (VALUES (1), (2), (3)) AS t(source_csn), "
    "(SELECT count(*) AS n, 100.0::DOUBLE AS accuracy_pct FROM orders)",
)
def ground_truth_check(spark, sf):
    checked = checked_set(order_ids(spark, sf), "cs1-3", "points", columns=SC.ITEM_INPUT, **ITEM_OPTIONS)
    return checked.withColumn("accuracy_pct", r6("accuracy_pct"))


@check(
    "error_partition",
    "F2 F4",
    lambda: _three_sql()
    + "SELECT source_csn, score < 1 AS is_error, count(*) AS n, round(min(score), 6) AS lowest, "
    "round(max(score), 6) AS highest FROM scored GROUP BY ALL",
)
def error_partition(spark, sf):
    rows = SC.with_error_flag(_three(spark, sf))
    return rows.groupBy("source_csn", "is_error").agg(
        F.count("*").alias("n"), r6(F.min("score")).alias("lowest"), r6(F.max("score")).alias("highest")
    )


@check(
    "error_rows",
    "F4",
    lambda: "WITH "
    + scored_sql(1)
    + " SELECT item_id, kind, generated, sql_statement AS expected, round(score, 6) AS score "
    "FROM scored WHERE score < 1",
)
def error_rows(spark, sf):
    rows = SC.below_full_score(scored_in_place(spark, sf, 1))
    return rows.select(
        "item_id", "kind", "generated", F.col("sql_statement").alias("expected"),
        r6(F.col("score")).alias("score"),
    )


@check(
    "effect_check",
    "F12",
    lambda: "WITH "
    + scored_sql(3)
    + ", m AS (SELECT kind AS run, avg(score) AS mean_score FROM scored GROUP BY kind) "
    "SELECT run, round(mean_score, 6) AS mean_score, round(b.plain, 6) AS plain_mean, "
    "mean_score <= b.plain + 0.001 AS holds FROM m, (SELECT mean_score AS plain FROM m WHERE run = 'duplicate') b",
)
def effect_check(spark, sf):
    runs = scored_in_place(spark, sf, 3).select(F.col("kind").alias("run"), "score")
    out = SC.effect_check(runs, baseline="duplicate")
    return out.withColumns({"mean_score": r6("mean_score"), "plain_mean": r6("plain_mean")})
