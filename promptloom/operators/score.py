"""Scoring jobs: items with predictions in, points out, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from promptloom.functions import scoring as P
from promptloom.functions.draws import with_computed

ITEM_INPUT = (
    "item_id", "source_csn", "command_set", "table_name", "select", "order_by", "sql_statement", "where",
    "join_table",
)


def score_rows(rows: DataFrame) -> DataFrame:
    """Points for rows that hold an item, its ``source_csn`` and a ``generated`` text.

    Adds ``earned``, ``possible``, ``score``, ``strict_score`` and ``exact``. Sets 4
    and 5 have no points scheme: their score is 0. Map-only, batch or streaming.
    """
    csn = F.col("source_csn")
    head, clause = F.col("_head"), F.col("_clause")
    tokens, truth = F.col("_tokens"), F.col("sql_statement")
    table, select = F.upper(F.col("table_name")["name"]), F.col("select")
    staged = (
        rows.withColumn("_norm", P.normalised(F.col("generated")))
        .withColumns(
            {
                # Set 1 takes the whole text; the others split off the ORDER BY clause.
                "_head": F.when(csn == 1, F.col("_norm")).otherwise(P.head_part(F.col("_norm"))),
                "_clause": F.when(csn == 1, F.lit("")).otherwise(P.order_part(F.col("_norm"))),
            }
        )
        .withColumn("_tokens", P.sql_tokens(head))
    )
    plain = P.select_points(head, tokens, truth, table, P.plain_fields(select))
    rich = P.select_points(
        head, tokens, truth, table, P.aggregate_fields(select), P.aggregate_aliases(select)
    )
    staged = staged.withColumns(
        {
            "_sel": F.when(csn == 3, rich).when(csn <= 2, plain),
            "_ord": F.when(csn <= 3, P.order_points(clause, F.col("order_by"))),
        }
    )
    counts = (csn <= 3) & (F.col("_norm") != "")
    points = with_computed(
        staged,
        {
            "earned": F.when(counts, F.col("_sel.earned") + F.col("_ord.earned")).otherwise(0),
            "possible": F.when(counts, F.col("_sel.possible") + F.col("_ord.possible")).otherwise(
                0
            ),
        },
    )
    return points.withColumns(
        {
            "score": F.coalesce(F.try_divide(F.col("earned"), F.col("possible")), F.lit(0.0)),
            "strict_score": strict_score(),
            "exact": (F.coalesce(F.col("generated"), F.lit("")) == truth).cast("int"),
        }
    ).drop("_norm", "_head", "_clause", "_tokens", "_sel", "_ord")


def strict_score() -> Column:
    """The score with the clauses it forgives: each is worth ten points.

    ORDER BY (when the item has one) must be there once; in sets 4 and 5, which have
    no other points, WHERE conditions, the joined table, the table and the SELECT
    fields must be in the text, names as whole words.
    """
    norm = F.col("_norm")
    wants_order = F.coalesce(F.size("order_by"), F.lit(0)) > 0
    parts = F.size(F.split(norm, P.ORDER_MARK)) - 1
    order_ok = F.when(wants_order, parts == 1).otherwise(parts == 0)
    low = F.when(
        (F.col("possible") > 0),
        F.col("earned") / (F.col("possible") + P.STEP_POINTS),
    )
    padded = F.when(
        F.col("possible") > 0,
        (F.col("earned") + P.STEP_POINTS) / (F.col("possible") + P.STEP_POINTS),
    )

    def named(word: Column) -> Column:  # as a whole word
        return F.regexp_instr(norm, F.concat(F.lit("\\b"), F.upper(word), F.lit("\\b"))) > 0

    fields = F.transform("select", lambda f: f["name"])
    conditions = F.coalesce(F.col("where"), F.array().cast("array<string>"))
    has_join = F.col("join_table").isNotNull()
    checks = (
        P.point(named(F.col("table_name")["name"]))
        + P.count_where(fields, named)
        + P.count_where(conditions, lambda c: F.contains(norm, F.upper(c)))
        + P.point(has_join & named(F.concat(F.lit("join "), F.col("join_table.name"))))
        + P.point(order_ok)
    )
    of = F.lit(2) + F.size(fields) + F.size(conditions) + P.point(has_join)
    return F.when(norm == "", F.lit(0.0)).otherwise(
        F.when(F.col("source_csn") <= 3, F.when(order_ok, padded).otherwise(low)).otherwise(
            checks / of
        )
    )


def score_predictions(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores per item and prediction kind; an item without a prediction scores 0.

    One equi-join on ``item_id``: AQE broadcasts the smaller side when its measured
    size allows, splits skewed partitions otherwise.
    """
    needed = items.select(*ITEM_INPUT)
    rows = needed.join(predictions.select("item_id", "kind", "generated"), "item_id", "left")
    return score_rows(rows)


def self_scores(items: DataFrame, scorer=score_rows) -> DataFrame:
    """The ground truth scored against itself."""
    truth = items.select(*ITEM_INPUT).withColumns(
        {"kind": F.lit("exact"), "generated": F.col("sql_statement")}
    )
    return scorer(truth)


# ------------------------------------------------------------------------ summaries
def mean_scores(scored: DataFrame, *by: str) -> DataFrame:
    """Mean score and exact-match share per group."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_score"),
        F.avg("exact").alias("exact_share"),
    )


def with_truth_score(scored: DataFrame) -> DataFrame:
    """Adds ``truth_score``, the score of the ground truth itself, in the same row."""
    own = ("earned", "possible", "strict_score", "exact")
    kept = scored.drop(*own).withColumnsRenamed({"score": "_score", "generated": "_generated"})
    truth = score_rows(kept.withColumn("generated", F.col("sql_statement"))).drop(*own, "generated")
    return truth.withColumnRenamed("score", "truth_score").withColumnsRenamed(
        {"_score": "score", "_generated": "generated"}
    )


def evaluation_summary(scored: DataFrame, truth_score: str = "truth_score") -> DataFrame:
    """Percentages of full scores, mean score and mean ground-truth score; 0 when empty."""

    def percent(value: Column) -> Column:
        return F.coalesce(F.avg(value) * 100, F.lit(0.0))

    return scored.agg(
        F.count("*").alias("n"),
        percent(F.when(F.col("score") == 1.0, 1).otherwise(0)).alias("full_score_pct"),
        percent(F.col("score")).alias("mean_score_pct"),
        percent(F.col(truth_score)).alias("truth_score_pct"),
    )


def self_check(items: DataFrame, scorer=score_rows) -> DataFrame:
    """Mean score of the ground truth in percent, per command set."""
    return (
        self_scores(items, scorer)
        .groupBy("source_csn")
        .agg(F.count("*").alias("n"), (F.avg("score") * 100).alias("accuracy_pct"))
    )


def with_error_flag(scored: DataFrame) -> DataFrame:
    """``is_error`` splits scored rows into correct (score 1) and errors."""
    return scored.withColumn("is_error", F.col("score") < 1.0)


def below_full_score(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("score") < 1.0)


def effect_check(runs: DataFrame, baseline: str, tolerance: float = 0.001) -> DataFrame:
    """Per run: does its mean score stay within ``tolerance`` above the baseline run's?"""
    means = runs.groupBy("run").agg(F.avg("score").alias("mean_score"))
    # Read off the means, so that the subquery reuses their shuffle.
    plain = means.agg(F.max(F.when(F.col("run") == baseline, F.col("mean_score")))).scalar()
    return means.withColumn("plain_mean", plain).withColumn(
        "holds", F.col("mean_score") <= F.col("plain_mean") + tolerance
    )


# ------------------------------------------------------------ predictions to try with
NOISE = "and some words nobody knows"
KINDS = ("exact", "noise_after", "duplicate", "clause_dropped", "json_like")


def perturbed(kind: str, sql: Column) -> Column:
    """A prediction made from the ground truth."""
    if kind == "exact":
        return sql
    if kind == "noise_after":
        return F.concat(sql, F.lit(" " + NOISE))
    if kind == "noise_before":
        return F.concat(F.lit(NOISE + " "), sql)
    if kind == "duplicate":
        return F.concat(sql, F.lit(" "), sql)
    if kind == "clause_dropped":
        return P.head_part(sql)
    if kind == "json_like":
        return F.concat(F.lit('{"sql": "'), sql, F.lit('", "note": "done"}'))
    if kind == "empty":
        return F.lit("")
    raise ValueError(f"unknown prediction kind: {kind}")


def with_perturbed(items: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds ``kind`` (``kinds[item_id % len(kinds)]``) and the ``generated`` text.

    Predictions made in the item's own row can be scored without any join.
    """
    number = F.pmod(F.col("item_id"), F.lit(len(kinds)))
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(kinds):
        kind = F.when(number == i, F.lit(name)).otherwise(kind)
        text = F.when(number == i, perturbed(name, F.col("sql_statement"))).otherwise(text)
    return items.withColumns({"kind": kind, "generated": text})


def perturbed_predictions(items: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One prediction per item, as a prediction table."""
    return with_perturbed(items, kinds).select("item_id", "kind", "generated")
