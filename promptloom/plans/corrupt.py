"""Check queries of the corruption job."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators import corrupt as C
from promptloom.plans.base import check, order_ids
from promptloom.plans.oracle import corrupt as O

TOKENS = "regexp_extract_all({}, '(\\w+|[^\\w\\s])', 1)"
PROMPT = (
    "trim(regexp_replace('### Instruction: ' || {} || ' ### Context: ' || {} || ' ### Response: ', "
    "'\\s+', ' ', 'g')) || ' '"
)
GROUPS = {
    "prompt": ("EngTableName", "EngFieldName"),
    "definition": ("DefCreateTable", "DefTableName", "DefFieldSeparator", "DefFieldName"),
    "order": ("DefOrderByField1", "DefOrderByField2", "DefOrderByDirection1", "DefOrderByDirection2"),
    "aggregate": (
        "DefAggregateFunction1", "DefAggregateFunction2", "DefAggregateField1", "DefAggregateField2",
    ),
    "where_join": ("DefWhereField1", "DefWhereLiteral1", "DefJoinTable1"),
}
NUMBERS = {
    "prompt": "K1 K2", "definition": "K3 K4 K5 K6", "order": "K7 K8 K9 K10",
    "aggregate": "K11 K12 K13 K14", "where_join": "K15 K16 K17",
}
# Features that put a novel name in a text.
NAMED = (
    "EngTableName", "EngFieldName", "DefTableName", "DefFieldName", "DefOrderByField1",
    "DefOrderByField2", "DefAggregateField1", "DefAggregateField2",
)
TEXTS = (
    "feature_name", "item_id", "clean_token", "corrupt_token", "answer_token", "english_prompt",
    "sql_statement", "corrupt_english_prompt", "corrupt_create_statement", "corrupt_sql_statement",
)


def _group(group: str):
    features = GROUPS[group]

    @check(
        f"corrupt_{group}",
        NUMBERS[group] + " K18 J7 N2 G25",
        lambda: f"WITH {O.candidates_ctes(features)} SELECT {', '.join(TEXTS)} FROM cand WHERE kept",
    )
    def run(spark, sf):
        return C.corrupt_items(order_ids(spark, sf), features).select(*TEXTS)


for _name in GROUPS:
    _group(_name)


@check(
    "corrupt_counts",
    "K18 F9",
    lambda: f"WITH {O.candidates_ctes()} SELECT feature_name, count(*) AS candidates, "
    "count(*) FILTER (WHERE kept) AS pairs, count(*) FILTER (WHERE NOT kept) AS dropped FROM cand GROUP BY feature_name",
)
def corrupt_counts(spark, sf):
    return C.feature_counts(order_ids(spark, sf))


@check(
    "corrupt_with_synonyms",
    "K1 K2 G25 N14",
    lambda: "WITH "
    + O.candidates_ctes(GROUPS["prompt"], syn_field=True, syn_table=True, num_fields=3)
    + " SELECT feature_name, item_id, clean_token, corrupt_token, answer_token, english_prompt, "
    "corrupt_english_prompt FROM cand WHERE kept",
)
def corrupt_with_synonyms(spark, sf):
    pairs = C.corrupt_items(
        order_ids(spark, sf), GROUPS["prompt"], use_synonyms_field=True, use_synonyms_table=True,
        num_fields=3,
    )
    return pairs.select(
        "feature_name", "item_id", "clean_token", "corrupt_token", "answer_token",
        "english_prompt", "corrupt_english_prompt",
    )


@check(
    "corrupt_novel_names",
    "K1 K2 K4 K5 K7 K8 K13 K14 K18",
    lambda: "WITH "
    + O.candidates_ctes(NAMED, novel=True)
    + " SELECT feature_name, item_id, clean_token, corrupt_token, corrupt_english_prompt, corrupt_create_statement, "
    "corrupt_sql_statement FROM cand WHERE kept",
)
def corrupt_novel_names(spark, sf):
    pairs = C.corrupt_items(order_ids(spark, sf), NAMED, use_novel_names=True)
    return pairs.select(
        "feature_name", "item_id", "clean_token", "corrupt_token", "corrupt_english_prompt",
        "corrupt_create_statement", "corrupt_sql_statement",
    )


@check(
    "corrupt_sanity",
    "F9",
    lambda: f"WITH {O.candidates_ctes()} SELECT feature_name, count(*) FILTER (WHERE NOT kept) AS violations, "
    "count(*) AS candidates FROM cand GROUP BY feature_name",
)
def corrupt_sanity(spark, sf):
    # Over all candidates, where there are violations to be found.
    rows = C.corrupt_candidates(order_ids(spark, sf)).select(
        "feature_name", "english_prompt", "create_statement", "sql_statement",
        "corrupt_english_prompt", "corrupt_create_statement", "corrupt_sql_statement",
    )
    return C.violation_counts(rows)


@check(
    "corrupt_views",
    "K19 P2",
    lambda: "WITH "
    + O.candidates_ctes()
    + ", p AS (SELECT * FROM cand WHERE kept) SELECT feature_name, item_id, "
    + PROMPT.format("english_prompt", "create_statement")
    + " AS clean_prompt, sql_statement AS clean_answer, "
    + PROMPT.format(
        "coalesce(corrupt_english_prompt, english_prompt)",
        "coalesce(corrupt_create_statement, create_statement)",
    )
    + " AS corrupt_prompt, coalesce(corrupt_sql_statement, sql_statement) AS corrupt_answer FROM p",
)
def corrupt_views(spark, sf):
    return C.both_views(C.corrupt_items(order_ids(spark, sf), prepare=C.with_clean_prompt))


def _positions_sql(**options) -> str:
    synonyms = "true" if options else "false"
    return (
        "WITH "
        + O.candidates_ctes(**options)
        + ", p AS (SELECT *, "
        + TOKENS.format(PROMPT.format("english_prompt", "create_statement"))
        + " AS pt, "
        + TOKENS.format("sql_statement")
        + " AS st FROM cand WHERE kept), q AS (SELECT *, list_filter(range(1, len(pt) + 1), lambda i: pt[i] = clean_token) "
        "AS found, list_position(st, 'WHERE') AS w FROM p), r AS (SELECT *, "
        f"CASE WHEN feature_name IN ('DefTableName', 'DefFieldName') AND NOT {synonyms} THEN coalesce(found[2], 0) "
        f"WHEN feature_name = 'DefFieldSeparator' AND NOT {synonyms} THEN coalesce(found[2], found[1], 0) "
        "ELSE coalesce(found[1], 0) END - 1 AS prompt_token_index, "
        "CASE WHEN feature_name = 'DefWhereField1' THEN coalesce(list_filter(range(1, len(st) + 1), "
        "lambda i: i > w AND st[i] = clean_token)[1], 0) ELSE coalesce(list_position(st, answer_token), 0) END - 1 AS a FROM q) "
        "SELECT feature_name, item_id, prompt_token_index, CASE WHEN a >= 0 THEN len(pt) + a - 1 ELSE -1 END AS answer_token_index, "
        "len(pt) AS prompt_length, array_to_string(list_slice(list_concat(pt, st), 1, CASE WHEN a >= 0 THEN len(pt) + a - 1 "
        "ELSE 0 END), ' ') AS truncated FROM r"
    )


def _positions(ids, **options):
    found = C.corrupt_positions(ids, keep_tokens=True, **options)
    cut = C.truncate_at_answer(F.col("tokens"), F.col("answer_token_index"))
    return found.select(
        "feature_name", "item_id", "prompt_token_index", "answer_token_index", "prompt_length",
        F.array_join(cut, " ").alias("truncated"),
    )


@check("corrupt_token_positions", "K20 K21 N13 P8 X3", _positions_sql)
def corrupt_token_positions(spark, sf):
    return _positions(order_ids(spark, sf))


@check(
    "corrupt_positions_with_synonyms",
    "K20 N14",
    lambda: _positions_sql(syn_field=True, syn_table=True),
)
def corrupt_positions_with_synonyms(spark, sf):
    return _positions(order_ids(spark, sf), use_synonyms_field=True, use_synonyms_table=True)


@check(
    "corrupt_length_check",
    "K23",
    lambda: "WITH "
    + O.candidates_ctes()
    + ", both_sides AS (SELECT feature_name, english_prompt AS e, create_statement AS c FROM cand WHERE kept UNION ALL "
    "SELECT feature_name, coalesce(corrupt_english_prompt, english_prompt), "
    "coalesce(corrupt_create_statement, create_statement) FROM cand WHERE kept), l AS (SELECT feature_name, len("
    + TOKENS.format(PROMPT.format("e", "c"))
    + ") AS n FROM both_sides) SELECT feature_name, count(DISTINCT n) AS lengths, min(n) AS shortest, "
    "max(n) AS longest FROM l GROUP BY feature_name",
)
def corrupt_length_check(spark, sf):
    return C.length_check(C.corrupt_items(order_ids(spark, sf), prepare=C.with_clean_length))


def _characters(texts):
    """A stand-in tokenizer: one token per character, its code as the id."""
    return [[ord(c) for c in text] for text in texts]


@check(
    "corrupt_token_ids",
    "K22 X3",
    lambda: "WITH "
    + O.candidates_ctes()
    + " SELECT feature_name, item_id, unicode(clean_token) AS clean_token_id, "
    "unicode(corrupt_token) AS corrupt_token_id FROM cand WHERE kept",
)
def corrupt_token_ids(spark, sf):
    # Offset 1 skips the token of the leading space, as it skips a start mark.
    pairs = C.with_token_ids(C.corrupt_items(order_ids(spark, sf)), _characters, 1)
    return pairs.select("feature_name", "item_id", "clean_token_id", "corrupt_token_id")
