"""Check queries of the run summaries, over tables derived from events, lineitem, embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from promptloom.functions import text as T
from promptloom.functions.vectors import round_nested
from promptloom.operators import runs as R
from promptloom.plans.base import check, r6
from promptloom.session import shared_folder
from promptloom.sources import corpus as D
from promptloom.sources.tables import table

def through_files(spark, documents, schema):
    """Documents written to a folder of their own in the shared one, and read back."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    D.write_documents(documents, folder)
    return D.read_documents(spark, folder, schema)


# ------------------------------------------------------------------ derived run tables
TRIES = (
    "tries AS (SELECT l_linenumber AS layer, l_suppkey % 8 AS head, l_partkey % 20 AS pos, "
    "l_discount >= 0.02 OR l_partkey % 20 = 3 AS same FROM lineitem)"
)


def tries(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("layer"),
        (F.col("l_suppkey") % 8).alias("head"),
        (F.col("l_partkey") % 20).alias("pos"),
        ((F.col("l_discount") >= 0.02) | (F.col("l_partkey") % 20 == 3)).alias("same"),
    )


EDGES = (
    "edges AS (SELECT day(ts) AS batch, 'head.' || (user_id % 3) || '.' || (user_id % 4) || '.q' AS from_edge, "
    "'mlp.' || (event_id % 5) AS to_edge, round(sum(CASE WHEN event_type = 'error' THEN -value ELSE value END), 4) AS score "
    "FROM events GROUP BY ALL)"
)


def edges(spark, sf):
    signed = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    return (
        table(spark, sf, "events")
        .groupBy(
            F.dayofmonth("ts").alias("batch"),
            F.concat(F.lit("head."), F.col("user_id") % 3, F.lit("."), F.col("user_id") % 4, F.lit(".q"))
            .alias("from_edge"),
            F.concat(F.lit("mlp."), F.col("event_id") % 5).alias("to_edge"),
        )
        .agg(F.round(F.sum(signed), 4).alias("score"))
    )


ACTIVATIONS = (
    "act AS (SELECT l_linenumber AS layer, l_suppkey % 8 AS head, l_partkey % 20 AS pos, l_orderkey AS prompt_id, "
    "l_extendedprice / 1000 AS clean, l_quantity AS corrupt, l_discount - 0.05 AS grad FROM lineitem)"
)


def activations(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") % 8).alias("head"),
        (F.col("l_partkey") % 20).alias("pos"), F.col("l_orderkey").alias("prompt_id"),
        (F.col("l_extendedprice") / 1000).alias("clean"), F.col("l_quantity").alias("corrupt"),
        (F.col("l_discount") - 0.05).alias("grad"),
    )


LATENTS = (
    "lat AS (SELECT label AS layer, vec_id, CASE WHEN vec_id % 4 = 0 THEN 'table' ELSE 'field' END AS tag, "
    "list_transform(range(64), lambda i: (i * (1 + vec_id % 3)) % 64) AS top_indices, embedding::DOUBLE[] AS top_acts "
    "FROM embeddings), feat AS (SELECT layer, vec_id, tag, unnest(top_indices) AS feature, unnest(top_acts) AS act FROM lat)"
)


def latents(spark, sf):
    step = 1 + F.col("vec_id") % 3
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("layer"),
        "vec_id",
        F.when(F.col("vec_id") % 4 == 0, F.lit("table")).otherwise(F.lit("field")).alias("tag"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * step) % 64).alias("top_indices"),
        F.col("embedding").cast("array<double>").alias("top_acts"),
    )


# ------------------------------------------------------------------------------ failures
@check(
    "failures_by_position",
    "A15",
    f"WITH {TRIES} SELECT pos, count(*) AS tries, count(*) FILTER (WHERE NOT same) AS fails, "
    "round(100.0 * count(*) FILTER (WHERE NOT same) / count(*), 2) AS failure_rate FROM tries GROUP BY pos",
)
def failures_by_position(spark, sf):
    return R.failure_rates(tries(spark, sf), "pos")


@check(
    "failures_by_head",
    "A16",
    f"WITH {TRIES} SELECT layer, head, pos, count(*) AS tries, count(*) FILTER (WHERE NOT same) AS fails, "
    "round(100.0 * count(*) FILTER (WHERE NOT same) / count(*), 2) AS failure_rate FROM tries GROUP BY ALL HAVING count(*) FILTER (WHERE NOT same) > 0",
)
def failures_by_head(spark, sf):
    return R.failure_rates(tries(spark, sf), "layer", "head", "pos", only_failing=True)


@check(
    "probability_drops",
    "F10",
    "SELECT event_type, round(value / 500, 6) < 0.5 AS is_drop, count(*) AS n FROM events GROUP BY ALL",
)
def probability_drops(spark, sf):
    rows = table(spark, sf, "events").withColumn("prob", F.round(F.col("value") / 500, 6))
    return R.probability_drops(rows).groupBy("event_type", "is_drop").agg(F.count("*").alias("n"))


@check(
    "unaided_examples",
    "F6",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = "
    "CASE WHEN c_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'HOUSEHOLD' END",
)
def unaided_examples(spark, sf):
    expected = F.when(F.col("c_nationkey") % 2 == 0, F.lit("BUILDING")).otherwise(F.lit("HOUSEHOLD"))
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("decoded"), expected.alias("expected")
    )
    return R.unaided(rows).select("c_custkey", F.col("decoded").alias("c_mktsegment"))


@check(
    "allowed_answers",
    "F5",
    "SELECT p_partkey, contains(p_name, string_split(p_name, ' ')[-1]) AS is_contained, "
    "p_type = CASE WHEN p_size > 10 THEN 'ECONOMY' ELSE p_type END AS type_kept FROM part",
)
def allowed_answers(spark, sf):
    allowed = F.when(F.col("p_size") > 10, F.lit("ECONOMY")).otherwise(F.col("p_type"))
    rows = table(spark, sf, "part").select(
        "p_partkey", F.substring_index("p_name", " ", -1).alias("answer"), F.col("p_name").alias("allowed"),
        F.col("p_type").alias("_type"), allowed.alias("_allowed_type"),
    )
    first = R.answer_allowed(rows).select("p_partkey", "is_contained", "_type", "_allowed_type")
    second = R.answer_allowed(
        first.select("p_partkey", F.col("is_contained").alias("_c"), F.col("_type").alias("answer"),
                     F.col("_allowed_type").alias("allowed"))
    )
    return second.select("p_partkey", F.col("_c").alias("is_contained"), F.col("is_equal").alias("type_kept"))


# -------------------------------------------------------------------------------- edges
@check(
    "top_edges_per_batch",
    "T3",
    f"WITH {EDGES} SELECT batch, from_edge, to_edge, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY batch "
    "ORDER BY abs(score) DESC, from_edge, to_edge) AS rank FROM edges) WHERE rank <= 10",
)
def top_edges_per_batch(spark, sf):
    return R.top_edges(edges(spark, sf), 10).select("batch", "from_edge", "to_edge", "score", "rank")


@check(
    "consistent_edges",
    "A17 T3",
    f"WITH {EDGES}, wide AS (SELECT batch % 3 AS batch, from_edge, to_edge, round(sum(abs(score)), 4) AS score FROM edges GROUP BY ALL), "
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY abs(score) DESC, "
    "from_edge, to_edge) AS rank FROM wide) WHERE rank <= 45), mean AS (SELECT from_edge, to_edge, round(avg(score), 6) AS mean_score "
    "FROM top GROUP BY ALL HAVING count(DISTINCT batch) = (SELECT count(DISTINCT batch) FROM top)) "
    "SELECT *, row_number() OVER (ORDER BY abs(mean_score) DESC, from_edge, to_edge) AS rank FROM mean",
)
def consistent_edges(spark, sf):
    wide = (
        edges(spark, sf)
        .groupBy((F.col("batch") % 3).alias("batch"), "from_edge", "to_edge")
        .agg(F.round(F.sum(F.abs("score")), 4).alias("score"))
    )
    out = R.consistent_edges(R.top_edges(wide, 45)).withColumn("mean_score", r6("mean_score"))
    # As many rows as there are kinds of edges: 60 by the way they are made.
    order = Window.orderBy(F.desc(F.abs("mean_score")), "from_edge", "to_edge")
    return out.withColumn("rank", F.row_number().over(order))


@check(
    "node_scores",
    "A18 N12 N15",
    f"WITH {EDGES}, n AS (SELECT from_edge AS node, score FROM edges UNION ALL SELECT to_edge, score FROM edges) "
    "SELECT node, regexp_replace(regexp_replace(node, '^mlp\\.([^.]*).*$', 'l\\1.mlp'), "
    "'^head\\.([^.]*)\\.([^.]*)(\\.[^.]+)$', 'l\\1.h\\2\\3') AS name, string_split(node, '.')[2]::INT AS layer, "
    "round(sum(score), 4) AS node_score FROM n GROUP BY node",
)
def node_scores(spark, sf):
    return R.node_scores(edges(spark, sf)).select(
        "node",
        T.rename_node(F.col("node")).alias("name"),
        T.layer_of(F.col("node")).alias("layer"),
        F.round("node_score", 4).alias("node_score"),
    )


@check(
    "edge_documents",
    "S11 N11 N12",
    f"WITH {EDGES} SELECT batch, 'l' || string_split(from_edge, '.')[2] || '.h' || string_split(from_edge, '.')[3] || '.q' "
    "AS from_edge, 'l' || string_split(to_edge, '.')[2] || '.mlp' AS to_edge, round(score / 3, 8) AS score FROM edges",
)
def edge_documents(spark, sf):
    # One document per batch; a batch has at most 60 edges by the way they are made.
    edge = F.struct("from_edge", "to_edge", (F.col("score") / 3).alias("score"))
    documents = (
        edges(spark, sf)
        .groupBy("batch")
        .agg(F.collect_list(edge).alias("edges"))
        .select(
            F.create_map(F.lit("batch"), F.col("batch").cast("string")).alias("metadata"),
            F.create_map(F.lit("top"), F.lit("60")).alias("parameters"),
            "edges",
        )
    )
    stored = through_files(spark, documents, D.EDGE_RESULT)
    batch = F.col("metadata")["batch"].cast("int").alias("batch")
    return R.edges_of_documents(stored.select(batch, "edges"))


# ------------------------------------------------------------------------- attributions
@check(
    "logit_differences",
    "A19 A20",
    "WITH l AS (SELECT l_linenumber AS layer, CASE l_returnflag WHEN 'A' THEN 'patched' WHEN 'N' THEN 'clean' ELSE 'corrupt' END "
    "AS run, avg(l_extendedprice / 1000 - l_quantity) AS d FROM lineitem GROUP BY ALL), m AS (SELECT layer, "
    "max(CASE WHEN run = 'patched' THEN d END) AS p, max(CASE WHEN run = 'clean' THEN d END) AS c, "
    "max(CASE WHEN run = 'corrupt' THEN d END) AS k FROM l GROUP BY layer) SELECT layer, round(p, 6) AS patched, "
    "round(k, 6) AS corrupt, round(c, 6) AS clean, round((p - k) / (c - k), 4) AS metric, round(-(p - k) / (c - k), 4) AS loss FROM m",
)
def logit_differences(spark, sf):
    run = (
        F.when(F.col("l_returnflag") == "A", F.lit("patched"))
        .when(F.col("l_returnflag") == "N", F.lit("clean"))
        .otherwise(F.lit("corrupt"))
    )
    logits = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("layer"), run.alias("run"),
        (F.col("l_extendedprice") / 1000).alias("correct"), F.col("l_quantity").alias("incorrect"),
    )
    out = R.normalised_metric(R.logit_difference(logits, "layer", "run"), "layer")
    return out.select(
        "layer", r6("patched").alias("patched"), r6("corrupt").alias("corrupt"), r6("clean").alias("clean"),
        F.round("metric", 4).alias("metric"), F.round("loss", 4).alias("loss"),
    )


def _attribution(name: str, by: tuple[str, ...]):
    @check(
        name,
        "A21",
        f"WITH {ACTIVATIONS} SELECT {', '.join(by)}, round(sum(grad * (clean - corrupt)), 4) AS attribution "
        "FROM act GROUP BY ALL",
    )
    def run(spark, sf):
        out = R.attribution(activations(spark, sf), *by)
        return out.withColumn("attribution", F.round("attribution", 4))


_attribution("attribution_by_position", ("layer", "pos"))
_attribution("attribution_by_head_and_position", ("layer", "head", "pos"))


@check(
    "attribution_at_last_position",
    "A21",
    f"WITH {ACTIVATIONS}, last AS (SELECT prompt_id, max(pos) AS pos FROM act GROUP BY prompt_id) "
    "SELECT layer, head, round(sum(grad * (clean - corrupt)), 4) AS attribution FROM act SEMI JOIN last USING (prompt_id, pos) "
    "GROUP BY ALL",
)
def attribution_at_last_position(spark, sf):
    rows = R.last_position(activations(spark, sf), "prompt_id")
    out = R.attribution(rows, "layer", "head")
    return out.withColumn("attribution", F.round("attribution", 4))


@check(
    "mean_activations",
    "A22 A24",
    "SELECT label AS layer, vec_id % 4 AS head, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean "
    "FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY ALL",
)
def mean_activations(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("label").alias("layer"), (F.col("vec_id") % 4).alias("head"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    return R.mean_activations(rows, "layer", "head").withColumn("mean", r6("mean"))


_BLOCKS = (
    "n AS (SELECT label, h AS head, sum(sqrt(list_sum(list_transform(list_slice(embedding::DOUBLE[], h * 8 + 1, h * 8 + 8), "
    "lambda x: x * x)))) AS magnitude FROM embeddings, unnest(range(8)) AS t(h) GROUP BY ALL)"
)


def heads(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("vector")
    )
    return R.block_norms(rows, 8, "label")


@check("block_norms", "A25", f"WITH {_BLOCKS} SELECT label, head, round(magnitude, 5) AS magnitude FROM n")
def block_norms(spark, sf):
    return heads(spark, sf).withColumn("magnitude", F.round("magnitude", 5))


@check(
    "important_heads",
    "W1",
    f"WITH {_BLOCKS}, d AS (SELECT *, magnitude - min(magnitude) OVER (PARTITION BY label) AS above FROM n), "
    "s AS (SELECT *, above / sum(above) OVER (PARTITION BY label) AS share FROM d), c AS (SELECT *, "
    "sum(share) OVER (PARTITION BY label ORDER BY magnitude DESC, head) AS cum FROM s) "
    "SELECT label, head, round(share, 5) AS contribution, round(cum, 5) AS cumulative FROM c WHERE cum - share < 0.8 - 1e-12",
)
def important_heads(spark, sf):
    out = R.important_heads(heads(spark, sf), 0.8, "label")
    return out.select(
        "label", "head", F.round("contribution", 5).alias("contribution"),
        F.round("cumulative", 5).alias("cumulative"),
    )


# ---------------------------------------------------------------------- sparse features
@check(
    "latent_weights",
    "A23",
    f"WITH {LATENTS}, r AS (SELECT layer, count(*) AS n FROM lat GROUP BY layer) SELECT layer, feature, "
    "round(sum(act) / any_value(n), 6) AS weight FROM feat JOIN r USING (layer) GROUP BY layer, feature",
)
def latent_weights(spark, sf):
    return R.latent_weights(latents(spark, sf)).withColumn("weight", r6("weight"))


@check(
    "feature_activations",
    "A32 F11",
    f"WITH {LATENTS} SELECT vec_id, round(max(act), 6) AS activation FROM feat WHERE feature = 9 AND tag = 'table' GROUP BY vec_id",
)
def feature_activations(spark, sf):
    tagged = latents(spark, sf).where(F.col("tag") == "table")
    return R.largest_activation(tagged, 9, "vec_id").withColumn("activation", r6("activation"))


@check(
    "most_activating_texts",
    "T8 A32",
    f"WITH {LATENTS} SELECT vec_id, round(max(act), 6) AS activation FROM feat WHERE feature = 12 GROUP BY vec_id "
    "ORDER BY max(act) DESC, vec_id LIMIT 20",
)
def most_activating_texts(spark, sf):
    out = R.most_activating(latents(spark, sf), 12, "vec_id", 20)
    return out.withColumn("activation", r6("activation"))


@check(
    "features_at_tag",
    "F11",
    f"WITH {LATENTS} SELECT layer, count(*) AS n, round(avg(act), 6) AS mean_act FROM feat WHERE tag = 'table' GROUP BY layer",
)
def features_at_tag(spark, sf):
    rows = R.features_at_tag(latents(spark, sf), "table")
    return rows.groupBy("layer").agg(F.count("*").alias("n"), r6(F.avg("act")).alias("mean_act"))


@check(
    "top_features_per_prompt",
    "W3",
    "WITH a AS (SELECT user_id AS prompt_id, day(ts) AS pos, event_id % 50 AS feature, max(value) AS act FROM events GROUP BY ALL), "
    "l AS (SELECT prompt_id, max(pos) AS pos FROM a GROUP BY prompt_id), r AS (SELECT a.*, row_number() OVER (PARTITION BY "
    "prompt_id ORDER BY act DESC, feature) AS rank FROM a SEMI JOIN l USING (prompt_id, pos)) "
    "SELECT prompt_id, feature, act, rank FROM r WHERE rank <= 3",
)
def top_features_per_prompt(spark, sf):
    rows = (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("prompt_id"), F.dayofmonth("ts").alias("pos"),
            (F.col("event_id") % 50).alias("feature"),
        )
        .agg(F.max("value").alias("act"))
    )
    return R.top_features(rows, 3).select("prompt_id", "feature", "act", "rank")


@check(
    "reconstruction_error",
    "A33",
    "SELECT p_size AS k, p_partkey % 6 AS layer, round(avg(abs(p_retailprice - 1000) / 1000), 6) AS mean_error FROM part GROUP BY ALL",
)
def reconstruction_error(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_size").alias("k"), (F.col("p_partkey") % 6).alias("layer"),
        (F.abs(F.col("p_retailprice") - 1000) / 1000).alias("error"),
    )
    return R.reconstruction_error(rows).withColumn("mean_error", r6("mean_error"))


# ------------------------------------------------------------------------ curves, ranks
_CURVE = (
    "c AS (SELECT experiment, k, round(1 - 1.0 / (1 + k) - v / 5000, 6) AS similarity FROM "
    "(SELECT event_type || (user_id % 5) AS experiment, day(ts) AS k, avg(value) AS v FROM events GROUP BY ALL))"
)


def curves(spark, sf):
    day = F.dayofmonth("ts")
    return (
        table(spark, sf, "events")
        .groupBy(F.concat("event_type", F.col("user_id") % 5).alias("experiment"), day.alias("k"))
        .agg(F.avg("value").alias("v"))
        .select(
            "experiment", "k", F.round(1 - 1.0 / (1 + F.col("k")) - F.col("v") / 5000, 6).alias("similarity")
        )
    )


@check(
    "stopping_points",
    "W2",
    f"WITH {_CURVE}, m AS (SELECT c.*, e.similarity AS earlier FROM c LEFT JOIN c e ON e.experiment = c.experiment "
    "AND e.k = c.k - 2), s AS (SELECT *, similarity >= 0.7 AND coalesce((similarity - earlier) / 2 < 0.01, false) AS stop FROM m), "
    "f AS (SELECT experiment, min(CASE WHEN stop THEN k END) AS first_k, max(k) AS last_k FROM s GROUP BY experiment) "
    "SELECT experiment, coalesce(first_k, last_k) AS k, similarity, first_k IS NOT NULL AS flattened FROM f JOIN c USING (experiment) "
    "WHERE c.k = coalesce(first_k, last_k)",
)
def stopping_points(spark, sf):
    return R.stopping_point(curves(spark, sf), 0.7, 3, 0.01)


@check(
    "sweep_curves",
    "A27",
    "SELECT l_linenumber AS layer, l_suppkey % 8 AS num_heads, CASE l_linestatus WHEN 'F' THEN 'mean' ELSE 'zero' END AS method, "
    "round(avg(1 - l_discount), 6) AS similarity FROM lineitem GROUP BY ALL",
)
def sweep_curves(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") % 8).alias("num_heads"),
        F.when(F.col("l_linestatus") == "F", F.lit("mean")).otherwise(F.lit("zero")).alias("method"),
        (1 - F.col("l_discount")).alias("similarity"),
    )
    return R.sweep_curve(rows).withColumn("similarity", r6("similarity"))


@check(
    "rotated_partners",
    "J5 W6",
    "WITH r AS (SELECT o_orderkey, o_custkey, o_orderkey // 16 AS batch FROM orders) "
    "SELECT o_orderkey, batch, coalesce(lead(o_custkey) OVER w, first_value(o_custkey) OVER w) AS partner "
    "FROM r WINDOW w AS (PARTITION BY batch ORDER BY o_orderkey)",
)
def rotated_partners(spark, sf):
    # Places with gaps, and batches without a place 0.
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.floor(F.col("o_orderkey") / 16).alias("batch"),
        (F.col("o_orderkey") % 16 * 3 + 1).alias("place"),
    )
    return R.rotated_partner(rows, "batch", "place", "o_custkey").select("o_orderkey", "batch", "partner")


@check(
    "target_ranks",
    "W7",
    "WITH l AS (SELECT l_linenumber AS layer, l_partkey AS token, max(l_extendedprice) AS logit FROM lineitem GROUP BY ALL), "
    "r AS (SELECT *, rank() OVER (PARTITION BY layer ORDER BY logit DESC) AS rank FROM l) "
    "SELECT layer, logit AS target_logit, rank FROM r WHERE token = 42",
)
def target_ranks(spark, sf):
    logits = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_linenumber").alias("layer"), F.col("l_partkey").alias("token"))
        .agg(F.max("l_extendedprice").alias("logit"))
    )
    return R.target_ranks(logits, F.col("token") == 42, "layer")


@check(
    "most_probable_tokens",
    "A34",
    "SELECT l_linenumber AS layer, l_suppkey % 20 AS pos, arg_max(l_partkey, (l_discount * 100 + l_quantity, -l_partkey)) AS token, "
    "max(l_discount * 100 + l_quantity) AS prob FROM lineitem GROUP BY ALL",
)
def most_probable_tokens(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") % 20).alias("pos"),
        F.col("l_partkey").alias("token"), (F.col("l_discount") * 100 + F.col("l_quantity")).alias("prob"),
    )
    return R.most_probable(rows, "layer", "pos")


_CATEGORIES = (
    "p AS (SELECT event_type AS example, user_id % 6 AS layer, CASE WHEN event_id % 3 = 0 THEN 'table' ELSE 'keyword' END "
    "AS category, avg(value / 500) AS m FROM events GROUP BY ALL)"
)
_MODES = {
    "raw": f"WITH {_CATEGORIES} SELECT example, layer, category, round(m, 6) AS score FROM p",
    "logit": f"WITH {_CATEGORIES}, q AS (SELECT *, least(greatest(m, 1e-6), 1 - 1e-6) AS c FROM p) "
    "SELECT example, layer, category, round(ln(c / (1 - c)), 6) AS score FROM q",
    "delta": f"WITH {_CATEGORIES} SELECT p.example, p.layer, p.category, round(p.m - b.m, 6) AS score FROM p "
    "JOIN p b ON b.example = p.example AND b.category = p.category AND b.layer = 0",
}


def _categories(mode: str):
    @check(f"category_scores_{mode}", "A28", _MODES[mode])
    def run(spark, sf):
        category = F.when(F.col("event_id") % 3 == 0, F.lit("table")).otherwise(F.lit("keyword"))
        rows = table(spark, sf, "events").select(
            F.col("event_type").alias("example"), (F.col("user_id") % 6).alias("layer"),
            category.alias("category"), (F.col("value") / 500).alias("prob"),
        )
        return R.category_scores(rows, mode).withColumn("score", r6("score"))


for _mode in _MODES:
    _categories(_mode)


@check(
    "latest_run_metrics",
    "A29",
    "WITH m AS (SELECT 'run' || (user_id % 10) AS run, user_id AS run_id, user_id AS created_at, event_id AS step, "
    "event_type || '/layer' || (event_id % 3) AS key, value FROM events), "
    "l AS (SELECT run, max(run_id) AS run_id FROM m GROUP BY run) "
    "SELECT run, string_split(key, '/')[1] AS metric, arg_max(value, step) AS value FROM m SEMI JOIN l USING (run, run_id) "
    "WHERE key LIKE '%layer1' GROUP BY ALL",
)
def latest_run_metrics(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("run"), F.col("user_id") % 10).alias("run"), F.col("user_id").alias("run_id"),
        F.col("user_id").alias("created_at"), F.col("event_id").alias("step"),
        F.concat("event_type", F.lit("/layer"), F.col("event_id") % 3).alias("key"), "value",
    )
    return R.latest_metrics(rows, "layer1")


# ------------------------------------------------------------------------ grids, matrices
@check(
    "setting_grid",
    "J6",
    "SELECT n_nationkey, novel, head, pos FROM nation, unnest([true, false]) AS a(novel), unnest(range(4)) AS b(head), "
    "unnest(range(6)) AS c(pos) WHERE NOT (novel AND n_nationkey % 5 = 0)",
)
def setting_grid(spark, sf):
    base = table(spark, sf, "nation").select("n_nationkey")
    axes = {"novel": [True, False], "head": list(range(4)), "pos": list(range(6))}
    return R.setting_grid(base, axes, F.col("novel") & (F.col("n_nationkey") % 5 == 0))


_NESTED = "e.embedding[l * 16 + h * 4 + p + 1]::DOUBLE"


def nested(spark, sf):
    def cut(values, size):
        count = F.floor(F.size(values) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * size + 1, F.lit(size)))

    doc = table(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.col("embedding"), lambda x: x.cast("double")).alias("v")
    )
    layers = F.transform(cut(F.col("v"), 16), lambda block: cut(block, 4))
    return doc.select("vec_id", layers.alias("results"))


@check(
    "patching_rows",
    "N16 S11 N11",
    f"SELECT vec_id, l AS layer, h AS head, p AS pos, round({_NESTED}, 8) AS value, 'L' || l || '_H' || h AS label "
    "FROM embeddings e, unnest(range(4)) AS a(l), unnest(range(4)) AS b(h), unnest(range(4)) AS c(p)",
)
def patching_rows(spark, sf):
    documents = nested(spark, sf).select(
        F.create_map(F.lit("vec_id"), F.col("vec_id").cast("string")).alias("metadata"),
        round_nested(F.col("results"), 8, depth=3).alias("results"),
    )
    stored = through_files(spark, documents, D.PATCHING_RESULT)
    vec_id = F.col("metadata")["vec_id"].cast("long").alias("vec_id")
    return R.patching_rows(stored.select(vec_id, "results"))


@check(
    "patching_matrix",
    "N16",
    "SELECT 'L' || l || '_H' || h AS label, "
    + ", ".join(
        f"round(avg(e.embedding[l * 16 + h * 4 + {p} + 1]::DOUBLE), 6) AS pos_{p}" for p in range(4)
    )
    + " FROM embeddings e, unnest(range(4)) AS a(l), unnest(range(4)) AS b(h) GROUP BY ALL",
)
def patching_matrix(spark, sf):
    wide = R.patching_matrix(R.patching_rows(nested(spark, sf)), [0, 1, 2, 3])
    return wide.select("label", *[r6(f"pos_{p}").alias(f"pos_{p}") for p in range(4)])


@check(
    "event_documents",
    "S11 S12",
    "SELECT event_type, (props::JSON ->> 'k')::INT % 10 AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
)
def event_documents(spark, sf):
    parsed = F.from_json("props", "k int")
    statistics = (
        table(spark, sf, "events")
        .groupBy("event_type", (parsed["k"] % 10).alias("k"))
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    )
    return through_files(spark, statistics, "event_type string, k int, n long, total double")
