"""Check queries of corpus profiles, samples, splits and flat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import text as T, tokens as K
from promptloom.operators import profile as P, sampling as M
from promptloom.plans.base import check, items, r6
from promptloom.plans.oracle.items import chance, draw, items_ctes, md5_of, words
from promptloom.sources import corpus as D
from promptloom.sources.tables import spread, table

SYN = {"syn_table": True, "syn_field": True}
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
UNIGRAMS = (
    "uni AS (SELECT token, count(*) AS n FROM (SELECT unnest("
    + WORDS.format("text")
    + ") AS token FROM documents) GROUP BY token HAVING count(*) >= 5)"
)
CLEAN = "translate({}, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', repeat(' ', 32))"
BLANK = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def pieces(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}'), lambda w: w <> '')"


def documents(spark, sf):
    return spread(table(spark, sf, "documents"))


def unigrams(spark, sf):
    return P.unigram_counts(documents(spark, sf), "text")


@check("unigram_counts", "A7 N10", f"WITH {UNIGRAMS} SELECT token, n AS count FROM uni")
def unigram_counts(spark, sf):
    return unigrams(spark, sf)


@check(
    "relative_frequencies",
    "A8",
    f"WITH {UNIGRAMS} SELECT token, round(n / (SELECT sum(n) FROM uni), 9) AS frequency FROM uni",
)
def relative_frequencies(spark, sf):
    out = P.relative_frequencies(unigrams(spark, sf))
    return out.select("token", F.round("frequency", 9).alias("frequency"))


@check(
    "most_frequent_words",
    "T1",
    f"WITH {UNIGRAMS} SELECT token, n AS count FROM uni ORDER BY n DESC, token LIMIT 50",
)
def most_frequent_words(spark, sf):
    return P.most_frequent(unigrams(spark, sf))


_TOKENS = (
    "tok AS (SELECT DISTINCT lang AS dataset, c AS \"column\", unnest("
    + pieces("lower(" + CLEAN.format("t") + ")")
    + ") AS token FROM (SELECT lang, 'text' AS c, text AS t FROM documents UNION ALL "
    "SELECT lang, 'source', source FROM documents)), "
    "bg AS (SELECT token, count(*) AS n FROM (SELECT unnest("
    + WORDS.format("text")
    + ") AS token FROM benchmark) GROUP BY token HAVING count(*) >= 5)"
)


def rates(spark, sf):
    tokens = P.distinct_tokens(documents(spark, sf), "lang", ["text", "source"])
    background = P.unigram_counts(table(spark, sf, "benchmark"), "text")
    return P.token_rates(tokens, background)


@check(
    "token_rates",
    "A9 A10 J3 N8 U3a",
    f"WITH {_TOKENS} SELECT dataset, \"column\", token, coalesce(n, 0) AS rate, coalesce(n, 0) < 5 AS is_rare "
    "FROM tok LEFT JOIN bg USING (token)",
)
def token_rates(spark, sf):
    return rates(spark, sf)


@check(
    "token_coverage",
    "A10 A11",
    f"WITH {_TOKENS} SELECT dataset, \"column\", count(*) AS num_tokens, count(*) FILTER (WHERE coalesce(n, 0) < 5) AS num_rare "
    "FROM tok LEFT JOIN bg USING (token) GROUP BY ALL",
)
def token_coverage(spark, sf):
    return P.coverage(rates(spark, sf))


@check(
    "words_in_vocabulary",
    "F7",
    "WITH w AS (SELECT DISTINCT unnest(" + WORDS.format("text") + ") AS word FROM conversations), "
    "v AS (SELECT DISTINCT unnest(" + WORDS.format("text") + ") AS token FROM benchmark) "
    "SELECT word FROM w SEMI JOIN v ON word = token",
)
def words_in_vocabulary(spark, sf):
    words_used = (
        table(spark, sf, "conversations")
        .select(F.explode(T.words_of(F.col("text"))).alias("word"))
        .distinct()
    )
    return P.in_vocabulary(words_used, P.unigram_counts(table(spark, sf, "benchmark"), "text", 1))


@check(
    "token_statistics",
    "A5 C1",
    "WITH t AS (SELECT role, len(" + pieces("text") + ") AS n FROM conversations) SELECT role, count(*) AS rows, "
    "round(avg(n), 6) AS mean_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM t GROUP BY role",
)
def token_statistics(spark, sf):
    out = P.token_statistics(table(spark, sf, "conversations"), T.blank_words(F.col("text")), "role")
    return out.withColumn("mean_tokens", r6("mean_tokens"))


@check(
    "longest_texts",
    "A6",
    lambda: f"WITH {items_ctes(3, **SYN)} SELECT "
    + ", ".join(
        f"max(len({pieces(c)})) AS {c}_words, max(length({c})) AS {c}_chars"
        for c in ("english_prompt", "create_statement", "sql_statement")
    )
    + " FROM items",
)
def longest_texts(spark, sf):
    columns = ["english_prompt", "create_statement", "sql_statement"]
    return P.longest_texts(items(spark, sf, 3), columns)


_LENGTHS = "l AS (SELECT *, len(" + pieces("text") + ") AS token_length FROM conversations)"


@check(
    "length_buckets",
    "A30",
    f"WITH {_LENGTHS} SELECT token_length, count(*) AS count FROM l GROUP BY 1 HAVING count(*) >= 8",
)
def length_buckets(spark, sf):
    length = F.size(T.blank_words(F.col("text")))
    return P.length_buckets(table(spark, sf, "conversations"), length, 8)


@check(
    "rows_of_common_lengths",
    "T2 F8",
    f"WITH {_LENGTHS}, top AS (SELECT token_length FROM l GROUP BY 1 ORDER BY count(*) DESC, token_length DESC LIMIT 3), "
    "k AS (SELECT conv_id * 1000 + turn AS row_id, token_length, row_number() OVER (PARTITION BY token_length ORDER BY "
    + md5_of(7, "(conv_id * 1000 + turn)")
    + ") AS rn FROM l SEMI JOIN top USING (token_length)) SELECT row_id, token_length FROM k WHERE rn <= 4",
)
def rows_of_common_lengths(spark, sf):
    length = F.size(T.blank_words(F.col("text")))
    df = table(spark, sf, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    rows = P.rows_of_lengths(df, length, P.common_lengths(df, length, 3))
    return M.sample_per_group(rows, "token_length", "row_id", 4).select("row_id", "token_length")


_METRICS = (
    "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY "
    + md5_of(7, "doc_id")
    + ", doc_id) AS rn FROM documents) WHERE rn <= 100), w AS (SELECT doc_id, lang, text, "
    + WORDS.format("text")
    + " AS ws FROM s), m AS (SELECT doc_id, lang, len(list_filter(ws, lambda x: NOT list_contains("
    + words(P.STOP_WORDS)
    + ", x))) / len(ws) AS density, 206.835 - 1.015 * len(ws) / greatest(len(regexp_extract_all(text, '[.!?]+')), 1) "
    "- 84.6 * list_sum(list_transform(ws, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1))) / len(ws) "
    "AS ease FROM w WHERE len(ws) > 0), r AS (SELECT doc_id, avg(ln(((SELECT sum(n) FROM uni) + 1) / (coalesce(n, 0) + 1))) "
    "AS rarity FROM (SELECT doc_id, unnest(ws) AS token FROM w) LEFT JOIN uni USING (token) GROUP BY doc_id)"
)


@check(
    "text_metrics",
    "A14 T6 N9",
    f"WITH {UNIGRAMS}, {_METRICS} SELECT s.lang, count(*) AS texts, round(avg(rarity), 5) AS rarity, "
    "round(avg(density), 5) AS lexical_density, round(avg(ease), 4) AS readability "
    "FROM s LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY s.lang",
)
def text_metrics(spark, sf):
    out = P.metrics_per_dataset(documents(spark, sf), "lang", "doc_id", "text", unigrams(spark, sf))
    return out.select(
        "lang", "texts", F.round("rarity", 5).alias("rarity"),
        F.round("lexical_density", 5).alias("lexical_density"),
        F.round("readability", 4).alias("readability"),
    )


# -------------------------------------------------------------------- flat rows, splits
@check(
    "flat_rows",
    "S9",
    lambda: f"WITH {items_ctes(2, **SYN)} SELECT item_id, command_set, tbl.name AS table_name, "
    "table_name.synonym AS table_name_synonym, table_name.use_synonym AS table_name_use_synonym, "
    "create_statement, english_prompt, sql_statement, to_json(table_fields)::VARCHAR AS table_fields, "
    "to_json(select_fields)::VARCHAR AS \"select\", to_json(order_by)::VARCHAR AS order_by FROM items",
)
def flat_rows(spark, sf):
    return D.to_flat(items(spark, sf, 2), "item_id")


@check(
    "flat_round_trip",
    "S10 S9",
    lambda: f"WITH {items_ctes(1, **SYN)} SELECT item_id, create_statement, len(select_fields) AS selected, "
    "true AS order_missing, true AS same FROM items",
)
def flat_round_trip(spark, sf):
    # What the fields were before goes along in the row: items are made once, and nothing is joined.
    df = items(spark, sf, 1).withColumn("before", F.col("table_fields"))
    back = D.from_flat(D.to_flat(df, "item_id", "before"), "item_id", "before")
    return back.select(
        "item_id", "create_statement", F.size("select").alias("selected"),
        F.col("order_by").isNull().alias("order_missing"),
        (F.col("before") == F.col("table_fields")).alias("same"),
    )


@check(
    "distinct_field_names",
    "A12",
    lambda: f"WITH {items_ctes(2, **SYN)} SELECT 'cs2' AS dataset, count(DISTINCT f.name) AS field_names FROM "
    "(SELECT unnest(table_fields) AS f FROM items)",
)
def distinct_field_names(spark, sf):
    flat = D.to_flat(items(spark, sf, 2)).withColumn("dataset", F.lit("cs2"))
    return P.field_names(flat)


@check(
    "fields_per_table",
    "A13",
    lambda: f"WITH {items_ctes(2, **SYN)} SELECT 'cs2' AS dataset, len(table_fields) AS fields, count(*) AS tables "
    "FROM items GROUP BY ALL",
)
def fields_per_table(spark, sf):
    flat = D.to_flat(items(spark, sf, 2)).withColumn("dataset", F.lit("cs2"))
    return P.fields_per_table(flat)


@check(
    "join_share",
    "F1",
    lambda: f"WITH {items_ctes(5, **SYN)} SELECT count(*) AS rows, count(*) FILTER (WHERE contains(sql_statement, 'JOIN')) AS with_word, "
    "round(avg(contains(sql_statement, 'JOIN')::INT), 6) AS share FROM items",
)
def join_share(spark, sf):
    return P.word_share(items(spark, sf, 5), "sql_statement", "JOIN").withColumn("share", r6("share"))


@check(
    "exact_splits",
    "W5",
    "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS k, count(*) AS c FROM lineitem GROUP BY 1), "
    "n AS (SELECT count(*) AS n, ceil(count(*) * 0.1) AS t FROM r), o AS (SELECT k, row_number() OVER (ORDER BY "
    + draw(7, "k", "split")
    + ", k) - 1 AS p FROM r) SELECT k, CASE WHEN p < t THEN 'test' WHEN p < t + ceil((n - t) * 0.15) THEN 'validation' "
    "ELSE 'train' END AS split FROM o, n",
)
def exact_splits(spark, sf):
    keys = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return M.split_exact(keys.distinct(), "k")


@check(
    "hash_splits",
    "W5",
    "SELECT CASE WHEN "
    + chance(0.1, 7, "o_orderkey", "split_test")
    + " THEN 'test' WHEN "
    + chance(0.15, 7, "o_orderkey", "split_validation")
    + " THEN 'validation' ELSE 'train' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM orders GROUP BY 1",
)
def hash_splits(spark, sf):
    rows = M.split_by_hash(table(spark, sf, "orders"), "o_orderkey")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@check(
    "seeded_sample",
    "T6 S14",
    "SELECT doc_id, lang FROM documents ORDER BY " + md5_of(11, "doc_id") + ", doc_id LIMIT 100",
)
def seeded_sample(spark, sf):
    return M.sample_rows(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100, 11)


@check(
    "quick_rows",
    "S14",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100",
)
def quick_rows(spark, sf):
    return M.quick_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@check(
    "seeded_shuffle",
    "T5",
    "SELECT p_partkey, p_name, row_number() OVER (ORDER BY " + md5_of(7, "p_partkey") + ", p_partkey) - 1 AS place FROM part",
)
def seeded_shuffle(spark, sf):
    return M.shuffled(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", place="place")


@check(
    "repeated_rows",
    "U2",
    "SELECT n_nationkey, n_name, copy FROM nation, unnest(range(6)) AS t(copy)",
)
def repeated_rows(spark, sf):
    return M.repeated(table(spark, sf, "nation").select("n_nationkey", "n_name"), 6)


# ------------------------------------------------------------------------ training rows
_TOK = "regexp_extract_all({}, '(\\w+|[^\\w\\s])', 1)"
_TRAIN = (
    "t AS (SELECT item_id, list_transform("
    + _TOK.format("'### Instruction: ' || english_prompt || ' ### Context: ' || create_statement || ' ### Response: '")
    + ", lambda w: length(w)) AS p, list_transform("
    + _TOK.format("sql_statement")
    + ", lambda w: length(w)) AS s FROM items), r AS (SELECT item_id, p, list_append(s, 1) AS r FROM t), "
    "k AS (SELECT item_id, list_slice(r, 1, {n}) AS a, list_slice(p, 1, greatest({n} - len(r), 0)) AS k FROM r)"
)
# The lengths that models are trained at, and short ones that cut every row.
TRAINING_LENGTH, ENCODER_LENGTH = 512, 450


def _training_sql(n: int, source: str) -> str:
    return (
        f"WITH {source}, {_TRAIN.replace('{n}', str(n))} SELECT item_id, "
        f"array_to_string(list_concat(list_concat(k, a), list_transform(range({n} - len(k) - len(a)), lambda i: 0)), ' ') AS input_ids, "
        f"array_to_string(list_concat(list_concat(list_transform(k, lambda x: -100), a), "
        f"list_transform(range({n} - len(k) - len(a)), lambda i: -100)), ' ') AS labels, len(k) + len(a) AS used FROM k"
    )


def _training_rows(rows, max_len):
    def ids(text):  # the length of a word stands in for its id
        return F.transform(K.word_tokens(text), lambda w: F.length(w))

    prompt = T.raw_prompt(F.col("english_prompt"), F.col("create_statement"))
    row = K.training_row(ids(prompt), ids(F.col("sql_statement")), end=1, pad=0, max_len=max_len)
    used = F.aggregate("r.attention_mask", F.lit(0), lambda a, b: a + b)
    return rows.select("item_id", row.alias("r")).select(
        "item_id",
        F.array_join("r.input_ids", " ").alias("input_ids"),
        F.array_join("r.labels", " ").alias("labels"),
        used.alias("used"),
    )


@check("training_rows", "P6 P11 X3", lambda: _training_sql(60, items_ctes(2, **SYN)))
def training_rows(spark, sf):
    return _training_rows(items(spark, sf, 2), 60)


@check(
    "training_rows_full",
    "P6 P11 X3",
    lambda: _training_sql(
        TRAINING_LENGTH,
        "items AS (SELECT doc_id AS item_id, text AS english_prompt, lang AS create_statement, source AS sql_statement FROM documents)",
    ),
)
def training_rows_full(spark, sf):
    # Whole documents as prompts: many are longer than the cap, so rows are cut and padded.
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("english_prompt"),
        F.col("lang").alias("create_statement"), F.col("source").alias("sql_statement"),
    )
    return _training_rows(rows, TRAINING_LENGTH)


def _padded_sql(n: int, keys: str, source: str) -> str:
    return (
        f"WITH t AS (SELECT {keys}, list_transform(" + pieces("text") + f", lambda w: length(w)) AS l FROM {source}) "
        f"SELECT {keys}, array_to_string(list_concat(list_slice(l, 1, {n}), list_transform(range(greatest({n} - len(l), 0)), "
        "lambda i: 0)), ' ') AS ids FROM t"
    )


def _padded(rows, n, *keys):
    lengths = F.transform(T.blank_words(F.col("text")), lambda w: F.length(w))
    return rows.select(*keys, F.array_join(K.fixed_length(lengths, n), " ").alias("ids"))


@check("padded_tokens", "P11", _padded_sql(45, "conv_id, turn", "conversations"))
def padded_tokens(spark, sf):
    return _padded(table(spark, sf, "conversations"), 45, "conv_id", "turn")


@check("padded_tokens_full", "P11", lambda: _padded_sql(ENCODER_LENGTH, "doc_id", "documents"))
def padded_tokens_full(spark, sf):
    return _padded(table(spark, sf, "documents"), ENCODER_LENGTH, "doc_id")


_NAMES = "list_distinct([lower(regexp_extract(text, '(?i)CREATE\\s+TABLE\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)), lower(regexp_extract(text, '(?i)\\bFROM\\s+([A-Za-z_][A-Za-z0-9_]*)', 1))])"
KEYWORDS = ("CREATE", "TABLE", "SELECT", "FROM", "ORDER", "BY", "WHERE", "JOIN", "AS")


@check(
    "token_prefixes",
    "P12 N4 N3",
    lambda: f"WITH {items_ctes(1, **SYN)}, t AS (SELECT item_id, create_statement || chr(10) || sql_statement AS text FROM items), "
    f"n AS (SELECT item_id, {_NAMES} AS names, {_TOK.format('text')} AS toks FROM t), "
    "e AS (SELECT item_id, names, toks, unnest(range(2, len(toks) + 1)) AS i FROM n) SELECT item_id, i - 1 AS position, "
    "toks[i] AS next_token, len(array_to_string(list_slice(toks, 1, i - 1), ' ')) AS prefix_chars, CASE WHEN upper(toks[i]) IN ("
    + ", ".join(f"'{k}'" for k in KEYWORDS)
    + ") THEN 'keyword' WHEN list_contains(names, lower(toks[i])) THEN 'table' ELSE 'other' END AS token_class FROM e",
)
def token_prefixes(spark, sf):
    text = T.schema_and_answer(F.col("create_statement"), F.col("sql_statement"))
    rows = items(spark, sf, 1).select(
        "item_id", T.table_names_of(text).alias("names"), K.word_tokens(text).alias("toks")
    )
    return (
        K.prefixes(rows, "toks", "item_id", "names")
        .select(
            "item_id", "position", "next_token",
            F.length(F.array_join("prefix", " ")).alias("prefix_chars"),
            K.token_class(F.col("next_token"), F.col("names"), KEYWORDS).alias("token_class"),
        )
    )
