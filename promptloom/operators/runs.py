"""Summaries of exported model-run tables: failures, edges, attributions, probes of layers.

Inputs are long tables (one row per layer, head, position, ...). Group sums combine
map-side before they are shuffled; windows run on rows that are already one per group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from promptloom.functions.text import head_label, rename_node
from promptloom.functions.vectors import norm, round_nested
from promptloom.operators.ranges import next_in_circle, running_sum

LOGIT_CLIP = 1e-6  # fixed value: probabilities are clipped by it before the logit
ROUNDING = 1e-12  # sums of shares that differ by less are equal
DROP_LIMIT = 0.5  # fixed value: probabilities below it count as a drop


# ------------------------------------------------------------------------- failures
def failure_rates(tries: DataFrame, *by: str, only_failing: bool = False) -> DataFrame:
    """Tries, fails and failure rate in percent (two decimals) per group of ``same`` flags."""
    rate = F.round(F.avg(F.when(F.col("same"), 0.0).otherwise(100.0)), 2)
    out = tries.groupBy(*by).agg(
        F.count("*").alias("tries"),
        F.count_if(~F.col("same")).alias("fails"),
        rate.alias("failure_rate"),
    )
    return out.where(F.col("failure_rate") > 0) if only_failing else out


def probability_drops(probabilities: DataFrame, limit: float = DROP_LIMIT) -> DataFrame:
    """Marks positions where the probability fell below the limit."""
    return probabilities.withColumn("is_drop", F.col("prob") < limit)


def unaided(examples: DataFrame) -> DataFrame:
    """Examples the model gets right without any intervention."""
    return examples.where(F.col("decoded") == F.col("expected"))


def answer_allowed(answers: DataFrame) -> DataFrame:
    """Is the answer contained in the allowed text, and is it equal to it?"""
    return answers.withColumns(
        {
            "is_contained": F.contains(F.col("allowed"), F.col("answer")),
            "is_equal": F.col("answer") == F.col("allowed"),
        }
    )


# ----------------------------------------------------------------------------- edges
def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` edges with the largest absolute score per batch (window group limit)."""
    order = Window.partitionBy("batch").orderBy(F.desc(F.abs("score")), "from_edge", "to_edge")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def consistent_edges(edges: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Edges present in every batch, with their mean score, largest absolute mean first.

    ``batches`` (one ``batch`` column) names the batches; default: those with edges.
    """
    named = (edges if batches is None else batches).select(F.count_distinct("batch")).scalar()
    return (
        edges.groupBy("from_edge", "to_edge")
        .agg(F.count_distinct("batch").alias("_batches"), F.avg("score").alias("mean_score"))
        .where(F.col("_batches") == named)
        .drop("_batches")
        .orderBy(F.desc(F.abs("mean_score")), "from_edge", "to_edge")
    )


def node_scores(edges: DataFrame) -> DataFrame:
    """Sum of the scores of all edges at either end of a node."""
    ends = F.explode(F.array("from_edge", "to_edge")).alias("node")
    return edges.select(ends, "score").groupBy("node").agg(F.sum("score").alias("node_score"))


def edges_of_documents(documents: DataFrame) -> DataFrame:
    """Edge rows of nested result documents, nodes renamed, scores to eight places."""
    return documents.select("*", F.inline("edges")).select(
        *[c for c in documents.columns if c != "edges"],
        rename_node(F.col("from_edge")).alias("from_edge"),
        rename_node(F.col("to_edge")).alias("to_edge"),
        round_nested(F.col("score")).alias("score"),
    )


# ------------------------------------------------------------------------ attributions
def logit_difference(logits: DataFrame, *by: str) -> DataFrame:
    return logits.groupBy(*by).agg(F.avg(F.col("correct") - F.col("incorrect")).alias("logit_diff"))


def normalised_metric(differences: DataFrame, *by: str) -> DataFrame:
    """(patched − corrupt) / (clean − corrupt) and its negative, from rows by ``run``."""

    def of(run: str) -> Column:
        return F.max(F.when(F.col("run") == run, F.col("logit_diff")))

    both = differences.groupBy(*by).agg(
        of("patched").alias("patched"), of("corrupt").alias("corrupt"), of("clean").alias("clean")
    )
    metric = F.try_divide(
        F.col("patched") - F.col("corrupt"), F.col("clean") - F.col("corrupt")
    )
    return both.withColumn("metric", metric).withColumn("loss", -F.col("metric"))


def attribution(activations: DataFrame, *by: str) -> DataFrame:
    """Sum of gradient × (clean − corrupt) per group."""
    part = F.col("grad") * (F.col("clean") - F.col("corrupt"))
    return activations.groupBy(*by).agg(F.sum(part).alias("attribution"))


def last_position(activations: DataFrame, *by: str) -> DataFrame:
    """Rows at the last position of each group."""
    last = activations.groupBy(*by).agg(F.max("pos").alias("pos"))
    return activations.join(last, [*by, "pos"], "left_semi")


def mean_activations(vectors: DataFrame, *by: str, column: str = "vector") -> DataFrame:
    """Mean per group and dimension, as long rows (…, dim, mean)."""
    return (
        vectors.select(*by, F.posexplode(column).alias("dim", "x"))
        .groupBy(*by, "dim")
        .agg(F.avg("x").alias("mean"))
    )


def block_norms(vectors: DataFrame, block: int, *by: str, column: str = "vector") -> DataFrame:
    """Norm of each head's block of a vector, summed over the vectors of a group."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(column) - 1) / block).cast("int")),
        lambda h: norm(F.slice(F.col(column), h * block + 1, F.lit(block))),
    )
    return (
        vectors.select(*by, F.posexplode(blocks).alias("head", "magnitude"))
        .groupBy(*by, "head")
        .agg(F.sum("magnitude").alias("magnitude"))
    )


# --------------------------------------------------------------------- sparse features
def feature_rows(latents: DataFrame) -> DataFrame:
    """One row per (row, feature) from the two parallel lists."""
    pairs = F.arrays_zip(F.col("top_indices").alias("feature"), F.col("top_acts").alias("act"))
    return latents.select(
        *[c for c in latents.columns if c not in ("top_indices", "top_acts")], F.inline(pairs)
    )


def latent_weights(latents: DataFrame, layer: str = "layer") -> DataFrame:
    """Summed activation per feature over the number of rows, per layer.

    Row counts come from the unexploded rows, so rows without activations count too.
    """
    rows = latents.groupBy(layer).agg(F.count("*").alias("_rows"))
    sums = feature_rows(latents).groupBy(layer, "feature").agg(F.sum("act").alias("_sum"))
    return sums.join(rows, layer).select(
        layer, "feature", (F.col("_sum") / F.col("_rows")).alias("weight")
    )


def largest_activation(latents: DataFrame, feature: int, key: str) -> DataFrame:
    """Largest activation of one feature per text."""
    return (
        feature_rows(latents)
        .where(F.col("feature") == feature)
        .groupBy(key)
        .agg(F.max("act").alias("activation"))
    )


def most_activating(latents: DataFrame, feature: int, key: str, n: int) -> DataFrame:
    """The ``n`` texts that activate a feature most."""
    return largest_activation(latents, feature, key).orderBy(F.desc("activation"), key).limit(n)


def features_at_tag(latents: DataFrame, tag: str) -> DataFrame:
    """Feature rows of one token tag."""
    return feature_rows(latents.where(F.col("tag") == tag))


def top_features(activations: DataFrame, n: int) -> DataFrame:
    """The ``n`` strongest features at the last position of each prompt."""
    order = Window.partitionBy("prompt_id").orderBy(F.desc("act"), "feature")
    at_last = last_position(activations, "prompt_id")
    return at_last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def reconstruction_error(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k", "layer").agg(F.avg("error").alias("mean_error"))


# -------------------------------------------------------------------- selection and sweeps
def important_heads(heads: DataFrame, threshold: float, *by: str) -> DataFrame:
    """The smallest set of heads that reaches a share of the total contribution.

    A head contributes its magnitude above the group's smallest one. Heads are kept, by
    falling magnitude, until their cumulative share reaches the threshold; all are kept
    when nothing contributes. One row per head and group comes in. Running sums go over ranges
    (``running_sum``), so a group may be larger than a task.
    """
    sizes = heads.groupBy(*by).agg(
        F.min("magnitude").alias("_least"), F.sum("magnitude").alias("_sum"), F.count("magnitude").alias("_n")
    )
    named = sizes.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_least", "_sum", "_n")
    matches = reduce(and_, [heads[c].eqNullSafe(named[f"_g{k}"]) for k, c in enumerate(by)], F.lit(True))
    share = F.try_divide(F.col("magnitude") - F.col("_least"), F.col("_sum") - F.col("_n") * F.col("_least"))
    shared = heads.join(named, matches).withColumn("contribution", F.coalesce(share, F.lit(0.0)))
    shared = shared.select(*heads.columns, "contribution")
    summed = running_sum(shared, by, [F.desc("magnitude"), F.col("head")], "contribution", "cumulative")
    return summed.where(F.col("cumulative") - F.col("contribution") < threshold - ROUNDING)


def stopping_point(
    curves: DataFrame, min_similarity: float = 0.7, window: int = 3, flat: float = 0.02
) -> DataFrame:
    """First ``k`` per experiment where the curve is high enough and flat; else the last.

    Flat: the mean improvement over the last ``window - 1`` steps is below ``flat``. The
    earlier point comes by an equi-join on (experiment, k), not by a window, so one long
    experiment does not end up in one task.
    """
    back = window - 1
    earlier = curves.select(
        "experiment", (F.col("k") + back).alias("k"), F.col("similarity").alias("_earlier")
    )
    flat_now = (F.col("similarity") - F.col("_earlier")) / back < flat
    marked = curves.join(earlier, ["experiment", "k"], "left").withColumn(
        "_stop",
        (F.col("similarity") >= min_similarity) & F.coalesce(flat_now, F.lit(False)),
    )
    pair = F.struct("k", "similarity")
    return (
        marked.groupBy("experiment")
        .agg(
            F.min(F.when(F.col("_stop"), pair)).alias("_first"),
            F.max(pair).alias("_last"),
        )
        .withColumn("_found", F.coalesce("_first", "_last"))
        .select(
            "experiment", "_found.k", "_found.similarity", F.col("_first").isNotNull().alias("flattened")
        )
    )


def sweep_curve(similarities: DataFrame) -> DataFrame:
    """Mean similarity by layer, number of heads kept and method."""
    return similarities.groupBy("layer", "num_heads", "method").agg(
        F.avg("similarity").alias("similarity")
    )


def rotated_partner(rows: DataFrame, batch: str, place: str, value: str) -> DataFrame:
    """Adds ``partner``: the value of the next row of the batch by place, the first for the last.

    Places may have gaps and start anywhere; equal places go by value. Ranges hand over their
    edges (``next_in_circle``), so a batch may be larger than a task.
    """
    return next_in_circle(rows, [batch], [place, value], value, "partner")


def target_ranks(logits: DataFrame, target: Column, *by: str, salts: int = 32) -> DataFrame:
    """Rank of the target among all scores of a group: one more than the scores above it.

    Group keys are few (layers), so each is dealt out over ``salts`` keys for the join; the
    counts of the parts are summed.
    """
    goal = logits.where(target).groupBy(*by).agg(F.max("logit").alias("target_logit"))
    every = goal.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = logits.withColumn("_salt", F.pmod(F.xxhash64(*logits.columns), F.lit(salts)).cast("int"))
    return (
        salted.join(every, [*by, "_salt"])
        .groupBy(*by)
        .agg(
            F.first("target_logit").alias("target_logit"),
            (F.count_if(F.col("logit") > F.col("target_logit")) + 1).alias("rank"),
        )
    )


def most_probable(probabilities: DataFrame, *by: str) -> DataFrame:
    """Most probable token and its probability per group (the smaller token among equals)."""
    best = F.max(F.struct(F.col("prob"), (-F.col("token")).alias("t")))
    return probabilities.groupBy(*by).agg(best.alias("_best")).select(
        *by, (-F.col("_best.t")).alias("token"), F.col("_best.prob").alias("prob")
    )


def category_scores(scores: DataFrame, mode: str = "raw", base_layer: int = 0) -> DataFrame:
    """Mean probability per example, layer and category: raw, logit, or delta to a layer."""
    means = scores.groupBy("example", "layer", "category").agg(F.avg("prob").alias("score"))
    if mode == "raw":
        return means
    if mode == "logit":
        p = F.least(F.greatest(F.col("score"), F.lit(LOGIT_CLIP)), F.lit(1 - LOGIT_CLIP))
        return means.withColumn("score", F.log(p / (1 - p)))
    if mode == "delta":
        base = means.where(F.col("layer") == base_layer).select(
            "example", "category", F.col("score").alias("_base")
        )
        joined = means.join(base, ["example", "category"])
        return joined.withColumn("score", F.col("score") - F.col("_base")).drop("_base")
    raise ValueError(f"unknown mode: {mode}")


def latest_metrics(metrics: DataFrame, suffix: str) -> DataFrame:
    """Last value of each metric whose key ends with the suffix, from the latest run by name.

    Rows hold run (name), run_id, created_at, step, key, value. Both steps are
    aggregations, so a run with very many steps is reduced map-side.
    """
    latest = metrics.groupBy("run").agg(
        F.max(F.struct("created_at", "run_id")).alias("_latest")
    ).select("run", F.col("_latest.run_id").alias("run_id"))
    return (
        metrics.where(F.endswith(F.col("key"), F.lit(suffix)))
        .join(latest, ["run", "run_id"], "left_semi")
        .groupBy("run", F.substring_index("key", "/", 1).alias("metric"))
        .agg(F.max_by("value", "step").alias("value"))
    )


# -------------------------------------------------------------------- grids and matrices
def setting_grid(base: DataFrame, axes: dict[str, list], exclude: Column | None = None) -> DataFrame:
    """Every base row with every combination of the axes, without excluded combinations.

    The axes are short lists of the program; they expand in place, nothing shuffles.
    """
    grid = base
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid if exclude is None else grid.where(~exclude)


def patching_rows(documents: DataFrame, column: str = "results") -> DataFrame:
    """Long rows (layer, head, pos, value, label) of a nested [layer][head][pos] list."""
    keep = [c for c in documents.columns if c != column]
    return (
        documents.select(*keep, F.posexplode(column).alias("layer", "_heads"))
        .select(*keep, "layer", F.posexplode("_heads").alias("head", "_positions"))
        .select(*keep, "layer", "head", F.posexplode("_positions").alias("pos", "value"))
        .withColumn("label", head_label(F.col("layer"), F.col("head")))
    )


def patching_matrix(rows: DataFrame, positions: list[int]) -> DataFrame:
    """Wide form: one row per label, one column per position. The positions are given, so
    the pivot needs no extra pass over the data."""
    wide = rows.groupBy("label").pivot("pos", positions).agg(F.avg("value"))
    return wide.select("label", *[F.col(str(p)).alias(f"pos_{p}") for p in positions])
