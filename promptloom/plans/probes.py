"""Check queries of the probe, the labelled union and the stored corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import text as T
from promptloom.operators import probe as B, sampling as M
from promptloom.plans.base import check, items, r6
from promptloom.plans.oracle.items import chance, items_ctes
from promptloom.plans.profiles import pieces
from promptloom.session import shared_folder, stored
from promptloom.sources import corpus as D
from promptloom.sources.tables import table


def _represent(text):
    """Counts of a few surface features, as a sparse map."""
    words = T.blank_words(text)
    counts = {
        "commas": F.regexp_count(text, F.lit(",")),
        "dots": F.regexp_count(text, F.lit("\\.")),
        "digits": F.regexp_count(text, F.lit("[0-9]")),
        "marks": F.regexp_count(text, F.lit("[#*%@]")),
        "lines": F.regexp_count(text, F.lit("\\n")),
        "words": F.size(words),
    }
    entries = F.array(
        *[F.struct(F.lit(k), F.log1p(v.cast("double")).alias("v")) for k, v in counts.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"] > 0))


def _parts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    both = docs.join(table(spark, sf, "labels"), "doc_id")
    return both.where("quality = 1").select("doc_id", "text"), both.where("quality = 0").select("doc_id", "text")


@check(
    "labelled_union",
    "U1 P10",
    "SELECT doc_id, text AS prompt, quality AS label FROM documents JOIN labels USING (doc_id)",
)
def labelled_union(spark, sf):
    correct, errors = _parts(spark, sf)
    return B.labelled(correct, errors, "text").select("doc_id", "prompt", "label")


@check(
    "feature_index",
    "U3b",
    "WITH k AS (SELECT DISTINCT event_type || '/' || (event_id % 7) AS feature FROM events) "
    "SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM k",
)
def feature_index(spark, sf):
    name = F.concat("event_type", F.lit("/"), F.col("event_id") % 7)
    rows = table(spark, sf, "events").select(F.create_map(name, F.col("value")).alias("representation"))
    return B.feature_index(rows)


@check(
    "prediction_accuracy",
    "A31",
    "SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, count(*) AS rows FROM labels",
)
def prediction_accuracy(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").alias("prediction"), F.col("toxic").alias("label"))
    return B.accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


_SURFACE = {
    "commas": "length(regexp_replace(text, '[^,]', '', 'g'))",
    "digits": "length(regexp_replace(text, '[^0-9]', '', 'g'))",
    "dots": "length(regexp_replace(text, '[^.]', '', 'g'))",
    "lines": "length(text) - length(replace(text, chr(10), ''))",
    "marks": "length(regexp_replace(text, '[^#*%@]', '', 'g'))",
    "words": "len(" + pieces("text") + ")",
}


@check(
    "probe_vectors",
    "M1 U3b",
    "WITH v AS (SELECT doc_id, quality AS label, ["
    + ", ".join(f"({n})::DOUBLE" for n in _SURFACE.values())
    + "] AS n FROM documents JOIN labels USING (doc_id)) SELECT doc_id, label, "
    "array_to_string(list_filter(range(6), lambda i: n[i + 1] > 0), ' ') AS indices, "
    "round(list_sum(list_transform(n, lambda x, i: i * ln(1 + x))), 6) AS weighed FROM v",
)
def probe_vectors(spark, sf):
    correct, errors = _parts(spark, sf)
    rows = B.labelled(correct, errors, "text").withColumn("representation", _represent(F.col("prompt")))
    index = stored(B.feature_index(rows))
    entries = B.feature_entries(rows, index, "doc_id", "label", 6)
    weighed = F.zip_with("features.indices", "features.values", lambda i, x: (i + 1) * x)
    return entries.select(
        "doc_id", "label", F.array_join("features.indices", " ").alias("indices"),
        r6(F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b)).alias("weighed"),
    )


@check(
    "probe_split",
    "M2 T5",
    lambda: "SELECT doc_id, (" + chance(0.2, 42, "doc_id", "probe_split") + ") AS test FROM labels",
)
def probe_split(spark, sf):
    return table(spark, sf, "labels").select("doc_id", B.is_test(F.col("doc_id"), 42, 0.2).alias("test"))


@check(
    "ranked_weights",
    "T4",
    "SELECT p_partkey AS idx, round(abs(p_retailprice - 1500), 6) AS importance FROM part "
    "ORDER BY importance DESC, idx LIMIT 25",
)
def ranked_weights(spark, sf):
    weights = table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"), r6(F.abs(F.col("p_retailprice") - 1500)).alias("importance")
    )
    return B.strongest(weights, 25)


def _newton_sql() -> str:
    """Newton rounds in SQL: sums of slope and Gram matrix, then elimination row by row."""
    p = len(_SURFACE) + 1
    ridge = [f"{1.0 if i < p else 0.0} + 1e-9" for i in range(1, p + 1)]
    row = [
        "[" + ", ".join(f"sum(c * (1 - c) * x[{i}] * x[{j}])" + (f" + {ridge[i - 1]}" if i == j else "") for j in range(1, p + 1))
        + f", sum((c - y) * x[{i}])" + (f" + any_value(w[{i}])" if i < p else "") + "]"
        for i in range(1, p + 1)
    ]
    solved = (
        f"list_reduce(range(1, {p + 1}), lambda m, k: list_transform(m, lambda r, i: CASE WHEN i = k "
        "THEN list_transform(r, lambda y: y / m[k][k]) ELSE list_transform(r, lambda y, j: y - r[k] / m[k][k] * m[k][j]) END), m0)"
    )
    counts = ", ".join(f"ln(1 + ({n}))::DOUBLE" for n in _SURFACE.values())
    zeros = "[" + ", ".join(["0.0"] * p) + "]::DOUBLE[]"
    dot = "list_dot_product(x, w)"
    longest = "greatest(list_max(list_transform(step, lambda v: abs(v))), 1e-300)"
    return (
        f"WITH RECURSIVE v AS (SELECT doc_id, quality::DOUBLE AS y, [{counts}, 1.0]::DOUBLE[] AS x, "
        + chance(0.2, 42, "doc_id", "probe_split")
        + " AS test FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)), "
        f"it AS (SELECT 0 AS round, {zeros} AS w UNION ALL SELECT round + 1, list_transform(w, lambda v, i: "
        f"v - step[i] * least(1.0, {B.LONGEST_STEP} / {longest})) FROM (SELECT round, w, list_transform({solved}, "
        f"lambda r: r[{p + 1}]) AS step FROM (SELECT round, any_value(w) AS w, [{', '.join(row)}] AS m0 FROM "
        f"(SELECT round, w, x, y, 1 / (1 + exp(-least(greatest({dot}, -30), 30))) AS c FROM it, v "
        f"WHERE NOT test AND round < {B.NEWTON_ROUNDS}) GROUP BY round))), "
        f"last AS (SELECT w FROM it WHERE round = {B.NEWTON_ROUNDS}), "
        f"hits AS (SELECT avg(((({dot}) > 0)::INT = y)::INT) AS accuracy FROM v, last WHERE test), "
        f"weights AS (SELECT unnest({list(_SURFACE)}) AS feature, abs(unnest(w[1:{p - 1}])) AS importance FROM last) "
        "SELECT feature, round(importance, 6) AS importance, round(accuracy, 6) AS accuracy FROM weights, hits "
        "ORDER BY weights.importance DESC LIMIT 5"
    )


@check("error_detection_probe", "M1 M2 T4 T5 A31", _newton_sql)
def error_detection_probe(spark, sf):
    correct, errors = _parts(spark, sf)
    probe = B.detect_errors(correct, errors, "doc_id", "text", _represent)
    hits = probe.accuracy.select("accuracy").scalar()
    return probe.top_features.select(
        "feature", r6("importance").alias("importance"), F.round(hits, 6).alias("accuracy")
    )


@check(
    "stored_corpus",
    "S7 S8 S9 W5 X4 P4",
    lambda: f"WITH {items_ctes(1, syn_table=True, syn_field=True)} SELECT item_id, 'test' AS split, "
    "'### Instruction: ' || english_prompt || ' ### Context: ' || create_statement || ' ### Response: ' || sql_statement "
    "AS text FROM items WHERE "
    + chance(0.1, 7, "item_id", "split_test"),
)
def stored_corpus(spark, sf):
    folder = f"{shared_folder(spark)}/corpus-{spark.sparkContext.applicationId}"
    flat = M.split_by_hash(D.to_flat(items(spark, sf, 1), "item_id"), "item_id")
    D.write_corpus(flat, folder, "cs1")

    def training(rows):
        text = T.training_text(F.col("english_prompt"), F.col("create_statement"), F.col("sql_statement"))
        return rows.select("item_id", "split", text.alias("text"))

    return D.read_corpus(spark, folder, "cs1", "test", mapper=training)


@check(
    "cached_counts",
    "S13",
    "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
)
def cached_counts(spark, sf):
    folder = f"{shared_folder(spark)}/cache-{spark.sparkContext.applicationId}"

    def build():
        return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))

    inputs = (f"{sf}/orders.parquet",)
    D.cached_result(spark, folder, "priority_counts", {}, build, inputs)
    return D.cached_result(spark, folder, "priority_counts", {}, build, inputs)
