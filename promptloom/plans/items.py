"""Check queries of the generators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from promptloom.functions import text as T
from promptloom.functions.draws import draw_below, pick_word
from promptloom.operators import generate as G
from promptloom.plans.base import ITEM_OPTIONS, check, items, order_ids, r6
from promptloom.plans.oracle import items as O
from promptloom.sources import vocabulary as V
from promptloom.sources.tables import table

SYN = {"syn_table": True, "syn_field": True}
TOPICS = ["banking", "weather", "sports", "travel", "cooking", "music", "health", "energy",
          "farming", "film"]
OPENERS = ["show", "list", "count", "rank", "compare", "find", "sum up", "average", "sort",
           "filter", "group"]


def _standard(csn: int):
    order = "" if csn == 1 else ", array_to_string(order_by_phrase, '|') AS order_phrases"
    extra = ", coalesce(array_to_string(where_texts, '|'), '') AS conditions" if csn >= 4 else ""
    if csn == 5:
        extra += ", join_table.name AS join_name, len(pairs) AS equal_type_pairs"

    @check(
        f"items_cs{csn}",
        "G1 G2 G3 G4 G5 G6 G7 G8 G9 G10 G11 G12 G13 G14 G15 G16 J4 N14 " + f"G{16 + csn} G22",
        "WITH " + O.items_ctes(csn, **SYN) + " SELECT item_id, command_set, source_csn, "
        "table_name.name AS tbl_name, table_name.synonym AS tbl_synonym, "
        "table_name.use_synonym AS tbl_use_synonym, create_statement, english_prompt, sql_statement, "
        f"array_to_string(agg_phrases, '|') AS aggregate_phrases{order}{extra} FROM items",
    )
    def run(spark, sf):
        df = items(spark, sf, csn)
        out = [
            "item_id", "command_set", "source_csn", F.col("table_name.name").alias("tbl_name"),
            F.col("table_name.synonym").alias("tbl_synonym"),
            F.col("table_name.use_synonym").alias("tbl_use_synonym"), "create_statement",
            "english_prompt", "sql_statement",
            F.array_join("agg_phrases", "|").alias("aggregate_phrases"),
        ]
        if csn > 1:
            out.append(F.array_join("order_by_phrase", "|").alias("order_phrases"))
        if csn >= 4:
            out.append(F.array_join("where", "|").alias("conditions"))
        if csn == 5:
            df = G.with_join_side(df, 7)
            other = F.col("_join_fields")
            pairs = G.equal_type_pairs(F.col("table_fields"), other)
            out += [F.col("join_table.name").alias("join_name"), F.size(pairs).alias("equal_type_pairs")]
        return df.select(*out)


for _csn in range(1, 6):
    _standard(_csn)


@check(
    "clause_shares",
    "G9 G10 G12 G17 G18 G19 G20 G21 F1",
    lambda: "WITH "
    + ", ".join(O.items_ctes(c, **SYN, name=f"i{c}") for c in range(1, 6))
    + " SELECT source_csn, count(*) AS n, "
    "round(avg(contains(sql_statement, ' ORDER BY ')::INT), 6) AS order_share, "
    "round(avg(contains(sql_statement, ' WHERE ')::INT), 6) AS where_share, "
    "round(avg(contains(sql_statement, 'JOIN')::INT), 6) AS join_share, "
    "round(avg(contains(sql_statement, '(')::INT), 6) AS paren_share FROM ("
    + " UNION ALL ".join(f"SELECT source_csn, sql_statement FROM i{c}" for c in range(1, 6))
    + ") GROUP BY source_csn",
)
def clause_shares(spark, sf):
    rows = G.generate_all_sets(order_ids(spark, sf), columns=("source_csn", "sql_statement"), **ITEM_OPTIONS)
    sql = F.col("sql_statement")

    def share(word):
        return r6(F.avg(F.contains(sql, F.lit(word)).cast("int")))

    return (
        rows.groupBy("source_csn")
        .agg(
            F.count("*").alias("n"),
            share(" ORDER BY ").alias("order_share"),
            share(" WHERE ").alias("where_share"),
            share("JOIN").alias("join_share"),
            share("(").alias("paren_share"),
        )
    )


@check(
    "order_by_index_rule",
    "G18 W4",
    lambda: "WITH "
    + O.items_ctes(2, total="(SELECT count(*) FROM orders)", order_p=0.75, use_aggregates=True)
    + " SELECT item_id, sql_statement, len(order_by) AS order_fields FROM items",
)
def order_by_index_rule(spark, sf):
    ids = order_ids(spark, sf)
    df = G.generate_items(
        ids, 2, total=ids.count(), order_by_probability=0.75, use_aggregates=True
    )
    return df.select("item_id", "sql_statement", F.size("order_by").alias("order_fields"))


@check(
    "aggregates_by_base_type",
    "G7 N1 N14",
    lambda: "WITH "
    + O.items_ctes(3, by_base_type=True)
    + ", f AS (SELECT item_id, unnest(select_fields) AS s FROM items) "
    "SELECT s.aggregate AS aggregate_name, count(*) AS n, count(DISTINCT s.name) AS names FROM f GROUP BY 1",
)
def aggregates_by_base_type(spark, sf):
    df = G.generate_items(order_ids(spark, sf), 3, aggregates_by_base_type=True)
    return (
        df.select(F.explode("select").alias("s"))
        .groupBy(F.col("s.aggregate").alias("aggregate_name"))
        .agg(F.count("*").alias("n"), F.count_distinct("s.name").alias("names"))
    )


# Size of the space: all vocabularies multiplied.
_PRODUCT = math.prod(
    (
        len(V.DEFAULT.tables), len(V.DEFAULT.fields), len(V.DEFAULT.select_templates),
        len(V.DEFAULT.order_phrases), sum(map(len, V.DEFAULT.agg_phrases.values())),
    )
)


@check(
    "vocabulary_coverage",
    "S1 S2 S3 S4 S5 S6",
    lambda: "WITH "
    + O.items_ctes(3, **SYN)
    + ", used AS (SELECT 'tables' AS vocabulary, tbl.name AS word FROM items UNION "
    "SELECT 'fields', regexp_replace(f.name, '_field$', '') FROM (SELECT unnest(table_fields) AS f FROM items) UNION "
    "SELECT 'order_phrases', unnest(order_by_phrase) FROM items UNION "
    "SELECT 'agg_phrases', unnest(agg_phrases) FROM items) "
    f", sizes AS (SELECT * FROM (VALUES ('tables', {len(V.DEFAULT.tables)}), ('fields', {len(V.DEFAULT.fields)}), "
    f"('order_phrases', {len(V.DEFAULT.order_phrases)}), "
    f"('agg_phrases', {sum(map(len, V.DEFAULT.agg_phrases.values()))}), "
    f"('select_templates', {len(V.DEFAULT.select_templates)}), ('product', {_PRODUCT})) AS t(vocabulary, size)) "
    "SELECT vocabulary, size, nullif(count(DISTINCT word), 0) AS used, "
    "round(nullif(count(DISTINCT word), 0) / size, 6) AS coverage FROM sizes LEFT JOIN used USING (vocabulary) "
    "GROUP BY vocabulary, size",
)
def vocabulary_coverage(spark, sf):
    df = items(spark, sf, 3)

    # Items are made once, and give their words of all vocabularies; equal words meet before any is edited.
    words = {
        "tables": F.array("table_name.name"),
        "fields": F.col("table_fields")["name"],
        "order_phrases": F.col("order_by_phrase"),
        "agg_phrases": F.col("agg_phrases"),
    }
    lists = F.array(*[F.struct(F.lit(name).alias("vocabulary"), F.coalesce(w, F.array().cast("array<string>")).alias("words")) for name, w in words.items()])
    every = df.select(F.inline(lists)).select("vocabulary", F.explode("words").alias("word")).distinct()
    plain = F.when(F.col("vocabulary") == "fields", F.regexp_replace("word", "_field$", "")).otherwise(F.col("word"))
    counts = every.groupBy("vocabulary").agg(F.count_distinct(plain).alias("used"))
    return (
        V.vocabulary_sizes(spark)
        .join(counts, "vocabulary", "left")  # items don't keep their template
        .select("vocabulary", "size", "used", r6(F.col("used") / F.col("size")).alias("coverage"))
    )


@check(
    "vocabulary_join",
    "J1 S2 G1",
    lambda: "WITH v AS (SELECT unnest(range("
    + str(len(V.DEFAULT.tables))
    + ")) AS idx, unnest("
    + O.words([t[0] for t in V.DEFAULT.tables])
    + ") AS name), d AS (SELECT "
    + O.draw_below(len(V.DEFAULT.tables), 7, "o_orderkey", "table")
    + " AS idx, o_totalprice FROM orders) SELECT name, count(*) AS n, "
    "round(sum(o_totalprice), 2) AS total FROM d JOIN v USING (idx) GROUP BY name",
)
def vocabulary_join(spark, sf):
    # The vocabulary is a constant of the program, so its broadcast has a fixed size.
    drawn = table(spark, sf, "orders").select(
        draw_below(len(V.DEFAULT.tables), 7, F.col("o_orderkey"), "table").alias("idx"),
        "o_totalprice",
    )
    return (
        drawn.join(F.broadcast(V.table_table(spark)), "idx")
        .groupBy("name")
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@check(
    "seed_column_draws",
    "G26",
    lambda: "SELECT "
    + O.pick_word(TOPICS, 7, "c_custkey", "seed_topic")
    + " AS topic, "
    + O.pick_word(OPENERS, 7, "c_custkey", "seed_opener")
    + " AS opener, count(*) AS n FROM customer GROUP BY ALL",
)
def seed_column_draws(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"))
    drawn = G.seed_columns(ids, {"topic": TOPICS, "opener": OPENERS})
    return drawn.groupBy("topic", "opener").agg(F.count("*").alias("n"))


@check(
    "phrase_draws",
    "G23 G24 S3 S5",
    lambda: "WITH d AS (SELECT o_orderkey, "
    + O.pick_word([*V.AGGREGATES, ""], 7, "o_orderkey", "agg_or_none")
    + " AS aggregate_name, "
    + O.pick_word(V.DEFAULT.select_templates, 7, "o_orderkey", "tpl")
    + " AS template FROM orders) SELECT aggregate_name, CASE aggregate_name "
    + " ".join(
        f"WHEN '{a}' THEN {O.pick_word(V.DEFAULT.agg_phrases[a], 7, 'o_orderkey', 'agg_or_none_phrase')}"
        for a in V.AGGREGATES
    )
    + " ELSE '' END AS phrase, count(*) AS n, count(DISTINCT template) AS templates FROM d GROUP BY ALL",
)
def phrase_draws(spark, sf):
    key = F.col("item_id")
    drawn = order_ids(spark, sf).select(
        G.draw_aggregate_phrase(key, 7).alias("d"),
        pick_word(V.DEFAULT.select_templates, 7, key, "tpl").alias("template"),
    )
    return drawn.groupBy(F.col("d.aggregate").alias("aggregate_name"), "d.phrase").agg(
        F.count("*").alias("n"), F.count_distinct("template").alias("templates")
    )


@check(
    "prompt_texts",
    "P1 P2 P3 P4 P5 P7 P9",
    lambda: "WITH "
    + O.items_ctes(2, **SYN)
    + ", t AS (SELECT *, '### Instruction: ' || english_prompt || ' ### Context: ' || create_statement || "
    "' ### Response: ' AS raw FROM items) "
    "SELECT item_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) || ' ' AS prompt, raw || sql_statement AS full_text, "
    "create_statement || chr(10) || sql_statement AS schema_answer, "
    "string_split(raw || sql_statement, 'Response: ')[1] || 'Response: ' AS prompt_part, "
    "string_split(raw || sql_statement, 'Response: ')[2] AS answer, "
    "'SELECT' || string_split(create_statement || ' ' || sql_statement, 'SELECT')[2] AS from_select, "
    "substr(raw || sql_statement, length(raw) + 1) AS continued FROM t",
)
def prompt_texts(spark, sf):
    english, create, sql = F.col("english_prompt"), F.col("create_statement"), F.col("sql_statement")
    full = F.col("full_text")
    return (
        items(spark, sf, 2)
        .withColumns({"raw": T.raw_prompt(english, create), "full_text": T.training_text(english, create, sql)})
        .select(
            "item_id",
            T.prompt_text(english, create).alias("prompt"),
            "full_text",
            T.schema_and_answer(create, sql).alias("schema_answer"),
            T.prompt_part(full).alias("prompt_part"),
            T.answer_part(full).alias("answer"),
            T.answer_from_select(F.concat_ws(" ", create, sql)).alias("from_select"),
            T.continuation(full, F.col("raw")).alias("continued"),
        )
    )
