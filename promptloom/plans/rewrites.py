"""Check queries of rewrites and similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import rewriting as R, text as T
from promptloom.functions.draws import draw_below
from promptloom.operators import corrupt as C, rewrite as W
from promptloom.plans.base import check, items, order_ids, r6
from promptloom.plans.oracle.corrupt import base_ctes
from promptloom.plans.oracle.items import items_ctes, pick_word, words
from promptloom.sources.tables import spread, table
from promptloom.sources.vocabulary import PAIRS

BASE = base_ctes("base", use_order_by=True)
PROMPTS = (
    f"WITH {BASE}, prompts AS (SELECT item_id, '### Instruction: ' || english_prompt || ' ### Context: ' || "
    "create_statement || ' ### Response: ' AS prompt FROM base) "
)


def prompts(spark, sf):
    base = C.make_base_items(order_ids(spark, sf), use_order_by=True)
    return base.select(
        "item_id", T.prompt_text(F.col("english_prompt"), F.col("create_statement")).alias("prompt")
    )


def _rewrite_sql() -> str:
    """What each rewrite must give, built from the item's own names and not by searching."""
    f1, f2, t = "table_fields[1].name", "table_fields[2].name", "tbl.name"
    y1, y2 = "table_fields[1].type", "table_fields[2].type"

    def said(a, b, c):
        start = "'show me the ' || {} || ' and ' || {} || ' from the ' || {} || ' table'"
        # What stands behind the table: the order, with the names as they were.
        rest = f"substr(english_prompt, length({start.format(f1, f2, t)}) + 1)"
        return f"{start.format(a, b, c)} || {rest}"

    def made(a, b, c):
        return f"'CREATE TABLE ' || {c} || ' ( ' || {a} || ' ' || {y1} || ', ' || {b} || ' ' || {y2} || ' )'"

    def prompt(instruction="english_prompt", context="create_statement"):
        return f"'### Instruction: ' || {instruction} || ' ### Context: ' || {context} || ' ### Response: '"

    def w(slot):
        return pick_word(PAIRS.random_words, 7, "item_id", slot)

    functions = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in R.FUNCTION_WORDS.items())
    by_word = (
        f"array_to_string(list_transform(string_split(english_prompt, ' '), lambda w: CASE w {functions} ELSE w END), ' ')"
    )
    kinds = {
        "SwapEng1": prompt(said(t, f2, f1)),
        "SwapEng2": prompt(said(f1, t, f2)),
        "SwapCreate1": prompt(context=made(t, f2, f1)),
        "SwapCreate2": prompt(context=made(f1, t, f2)),
        "RandomEng1": prompt(said(w("r_eng1"), f2, t)),
        "RandomEng2": prompt(said(f1, w("r_eng2"), t)),
        "RandomCreate1": prompt(context=made(w("r_create1"), f2, t)),
        "RandomCreate2": prompt(context=made(f1, w("r_create2"), t)),
        "FunctionWords": prompt(by_word),
    }
    rows = " UNION ALL ".join(f"SELECT item_id, '{k}' AS kind, {e} AS rewritten FROM base" for k, e in kinds.items())
    return f"WITH {BASE} {rows}"


@check("prompt_rewrites", "R1 R2 R3 R4 R5 R6 R7 X2", _rewrite_sql)
def prompt_rewrites(spark, sf):
    return W.rewrite_prompts(prompts(spark, sf)).select("item_id", "kind", "rewritten")


def _sweep(name: str, covers: str):
    old, new_words = R.SWEEPS[name]
    # The words of a prompt stand between single blanks; a sign may touch a word.
    swept = (
        f"array_to_string(list_transform(string_split(p, ' '), lambda w: CASE WHEN w = '{old}' THEN word ELSE w END), ' ')"
        if old.isalpha()
        else f"replace(p, '{old}', word)"
    )

    @check(
        f"sweep_{name}",
        covers,
        lambda: PROMPTS
        + f"SELECT item_id, word, md5({swept}) AS digest FROM (SELECT item_id, replace(prompt, 'show me', 'select') AS p "
        f"FROM prompts), unnest({words(new_words)}) AS t(word)",
    )
    def run(spark, sf):
        return W.sweep_prompts(prompts(spark, sf), name).select(
            "item_id", "word", F.md5("rewritten").alias("digest")
        )


for _name, _covers in (
    ("EngFieldStart", "R8"), ("DefCreateTable", "R9"), ("EngFieldSeparator", "R10"),
    ("DefFieldSeparator", "R10"),
):
    _sweep(_name, _covers)


@check(
    "prompt_parts",
    "N7 N3",
    lambda: PROMPTS
    + ", t AS (SELECT item_id, prompt || sql_statement AS text FROM prompts JOIN base USING (item_id)) SELECT item_id, "
    + ", ".join(
        f"nullif(regexp_extract(text, '{pattern}', {group}), '') AS {name}"
        for name, (pattern, group) in R.PART_PATTERNS.items()
    )
    + ", array_to_string(list_sort(list_distinct([lower(regexp_extract(text, '(?i)CREATE\\s+TABLE\\s+([a-z_][a-z0-9_]*)', 1)), "
    "lower(regexp_extract(text, '(?i)\\bFROM\\s+([a-z_][a-z0-9_]*)', 1))])), ',') AS table_names FROM t",
)
def prompt_parts(spark, sf):
    base = C.make_base_items(order_ids(spark, sf), use_order_by=True)
    prompt = T.prompt_text(F.col("english_prompt"), F.col("create_statement"))
    texts = base.select("item_id", F.concat(prompt, F.col("sql_statement")).alias("text"))
    return W.with_parts(texts).select(
        "item_id", *R.PART_PATTERNS, F.array_join(T.table_names_of(F.col("text")), ",").alias("table_names")
    )


# Pairs of neighbouring items, so that parts agree and differ.
def _pairs_sql() -> str:
    return (
        f"WITH {items_ctes(3, syn_table=True, syn_field=True)}, {base_ctes('base', use_order_by=True)}, "
        "p AS (SELECT item_id, 'set3' AS source, sql_statement AS a, replace(replace(sql_statement, 'ASC', "
        "CASE WHEN item_id % 3 = 0 THEN 'DESC' ELSE 'ASC' END), ', ', CASE WHEN item_id % 4 = 0 THEN ' AND ' ELSE ', ' END) AS b "
        "FROM items UNION ALL SELECT x.item_id, 'base', x.sql_statement, y.sql_statement FROM base x JOIN base y "
        "ON y.item_id = x.item_id + 1 UNION ALL SELECT item_id, 'mixed', sql_statement, create_statement FROM base) "
    )


def pairs(spark, sf):
    cs3 = items(spark, sf, 3)
    a = F.col("sql_statement")
    direction = F.when(F.col("item_id") % 3 == 0, F.lit("DESC")).otherwise(F.lit("ASC"))
    comma = F.when(F.col("item_id") % 4 == 0, F.lit(" AND ")).otherwise(F.lit(", "))
    b = F.replace(F.replace(a, F.lit("ASC"), direction), F.lit(", "), comma)
    base = C.make_base_items(order_ids(spark, sf), use_order_by=True)
    left = base.select("item_id", a.alias("a"))
    right = base.select((F.col("item_id") - 1).alias("item_id"), a.alias("b"))
    rows = [
        cs3.select("item_id", F.lit("set3").alias("source"), a.alias("a"), b.alias("b")),
        left.join(right, "item_id").select("item_id", F.lit("base").alias("source"), "a", "b"),
        base.select("item_id", F.lit("mixed").alias("source"), a.alias("a"), F.col("create_statement").alias("b")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _similarity_ctes() -> str:
    def sel(t):
        start = f"(strpos({t}, 'SELECT') + 6)"
        end = f"(CASE WHEN contains({t}, 'FROM') THEN strpos({t}, 'FROM') - 1 ELSE length({t}) - 1 END)"
        return f"trim(substr({t}, {start} + 1, greatest({end} - {start}, 0)))"

    def cols(t):
        return f"list_transform(string_split({sel(t)}, ','), lambda c: trim(c))"

    def behind(t, w):
        return f"substr({t}, strpos({t}, '{w}') + {len(w) + 1})"

    def word_list(t):
        return f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"

    def has(t, w):
        return f"contains({t}, '{w}')"

    def count_as(t):
        return f"((length({t}) - length(replace({t}, 'AS', ''))) // 2)"

    select_points = (
        "(contains(a, 'SELECT') AND contains(b, 'SELECT'))::INT + (contains(a, 'FROM') AND contains(b, 'FROM'))::INT "
        "+ (ca[1] = cb[1])::INT + coalesce(ca[2] = cb[2], false)::INT"
    )
    five = f"({select_points} + (trim({behind('a', 'FROM')}) = trim({behind('b', 'FROM')}))::INT) / 5.0"
    eight = (
        f"({select_points} + (string_split({behind('a', 'FROM')}, ' ')[1] = string_split({behind('b', 'FROM')}, ' ')[1])::INT "
        "+ (contains(a, 'ORDER BY') AND contains(b, 'ORDER BY'))::INT + coalesce(oa[1] = ob[1], false)::INT "
        "+ coalesce(upper(oa[2]) = upper(ob[2]), false)::INT) / 8.0"
    )
    earned = " + ".join(f"({has('ta', w)} = {has('tb', w)})::INT" for w in ("SELECT", "FROM", "ORDER BY", "AS"))
    earned += f" + least({count_as('ta')}, {count_as('tb')})"
    possible = f"4 + greatest({count_as('ta')}, {count_as('tb')})"
    looks = {
        "FROM": lambda t: f"({word_list(behind(t, 'FROM'))})[1]",
        "ORDER BY": lambda t: f"({word_list(behind(t, 'ORDER BY'))})[1]",
        "AS": lambda t: f"({word_list(f'string_split({t}, {chr(39)}AS{chr(39)})[-1]')})[1]",
    }
    for w, look in looks.items():
        possible += f" + ({has('ta', w)} OR {has('tb', w)})::INT"
        earned += f" + ({has('ta', w)} AND {has('tb', w)} AND coalesce({look('ta')} = {look('tb')}, false))::INT"
    whole = " AND ".join(has(t, w) for t in ("ta", "tb") for w in ("SELECT", "FROM"))
    earned += (
        f" + CASE WHEN {whole} THEN (contains({sel('ta')}, ',') AND contains({sel('tb')}, ','))::INT + "
        "coalesce(list_sum(list_transform(xa, lambda p: len(list_filter(xb, lambda q: q = p)))), 0) ELSE 0 END"
    )
    possible += (
        f" + CASE WHEN {whole} THEN (contains({sel('ta')}, ',') OR contains({sel('tb')}, ','))::INT + "
        "greatest(len(xa), len(xb)) ELSE 0 END"
    )
    s1 = (
        f"SELECT *, trim(a) AS ta, trim(b) AS tb, {cols('a')} AS ca, {cols('b')} AS cb, "
        f"CASE WHEN contains(a, 'ORDER BY') THEN {word_list(behind('a', 'ORDER BY'))} END AS oa, "
        f"CASE WHEN contains(b, 'ORDER BY') THEN {word_list(behind('b', 'ORDER BY'))} END AS ob FROM p"
    )
    s2 = f"SELECT *, {cols('ta')} AS xa, {cols('tb')} AS xb FROM ({s1})"
    return (
        f", sim AS (SELECT item_id, source, {five} AS five_point, {eight} AS eight_point, "
        f"({earned})::DOUBLE / ({possible}) AS clause_points FROM ({s2})) "
    )


@check(
    "sql_similarity",
    "C13 C14 C15",
    lambda: _pairs_sql()
    + _similarity_ctes()
    + "SELECT item_id, source, round(five_point, 6) AS five_point, round(eight_point, 6) AS eight_point, "
    "round(clause_points, 6) AS clause_points FROM sim",
)
def sql_similarity(spark, sf):
    out = W.compare_sql(pairs(spark, sf))
    return out.select(
        "item_id", "source", r6("five_point").alias("five_point"),
        r6("eight_point").alias("eight_point"), r6("clause_points").alias("clause_points"),
    )


def _answer(prompt):
    """A stand-in for a model: the SQL that a prompt's own words ask for."""
    field1 = R.found(prompt, "show me the (\\w+)")
    field2 = R.found(prompt, R.SECOND_SAID)
    return F.concat(F.lit("SELECT "), field1, F.lit(", "), field2, F.lit(" FROM "), R.found(prompt, R.TABLE_DEFINED))


def _answer_sql() -> str:
    """The same answers, from the item's names: a rewrite that the stand-in can't read gives none."""
    f1, f2, t = "table_fields[1].name", "table_fields[2].name", "tbl.name"

    def w(slot):
        return pick_word(PAIRS.random_words, 7, "item_id", slot)

    names = {
        "SwapEng1": (t, f2, t), "SwapEng2": (f1, t, t), "SwapCreate1": (f1, f2, f1), "SwapCreate2": (f1, f2, f2),
        "RandomEng1": (w("r_eng1"), f2, t), "RandomEng2": (f1, w("r_eng2"), t),
        "RandomCreate1": (f1, f2, t), "RandomCreate2": (f1, f2, t), "FunctionWords": None,
    }

    def text(parts):
        return "'SELECT ' || {} || ', ' || {} || ' FROM ' || {}".format(*parts) if parts else "NULL::VARCHAR"

    rows = " UNION ALL ".join(
        f"SELECT item_id, '{kind}' AS kind, {text((f1, f2, t))} AS a, {text(parts)} AS b FROM base"
        for kind, parts in names.items()
    )
    return f"WITH {BASE}, p AS (SELECT item_id, kind AS source, a, b FROM ({rows})) "


@check(
    "similarity_by_kind",
    "A26",
    lambda: _answer_sql()
    + _similarity_ctes()
    + "SELECT p.source AS kind, coalesce(round(avg(CASE WHEN p.b IS NOT NULL THEN eight_point END), 6), 0) AS mean_similarity, "
    "count(p.b) AS successes, round(count(p.b) / count(*), 6) AS success_rate "
    "FROM p JOIN sim USING (item_id, source) GROUP BY p.source",
)
def similarity_by_kind(spark, sf):
    # Answers to the rewritten prompts against the answer to the prompt as it was.
    rows = W.rewrite_prompts(prompts(spark, sf)).select(
        "kind", _answer(F.col("prompt")).alias("a"), _answer(F.col("rewritten")).alias("b")
    )
    scored = W.compare_sql(rows).withColumn("similarity", F.when(F.col("b").isNotNull(), F.col("eight_point")))
    out = W.similarity_summary(scored, "kind")
    return out.withColumns(
        {"mean_similarity": r6("mean_similarity"), "success_rate": r6("success_rate")}
    )


_COS = (
    "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
)


def _cos(a, b):
    return f"{_COS.format(a=a, b=b)} / (sqrt({_COS.format(a=a, b=a)}) * sqrt({_COS.format(a=b, b=b)}))"


@check(
    "output_similarity",
    "J8 J9 N5 N6",
    "WITH o AS (SELECT o_orderkey AS item_id, [o_custkey % 500, o_orderkey % 500, 7] AS a, "
    "[o_orderkey % 400, o_orderkey % 500] AS b FROM orders), z AS (SELECT item_id, unnest(range(1, 3)) AS i, a, b FROM o), "
    "s AS (SELECT item_id, CASE WHEN a[i] = b[i] THEN 1.0 ELSE "
    + _cos("x.embedding", "y.embedding")
    + " END AS s FROM z JOIN embeddings x ON x.vec_id = a[i] JOIN embeddings y ON y.vec_id = b[i]) "
    "SELECT item_id, round(avg(s), 5) AS similarity FROM s GROUP BY item_id",
)
def output_similarity(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    outputs = spread(table(spark, sf, "orders")).select(
        key.alias("item_id"),
        F.concat_ws(" ", cust % 500, key % 500, F.lit(7)).alias("a"),
        F.concat_ws(" ", key % 400, key % 500).alias("b"),
    )
    vectors = W.word_vectors(
        table(spark, sf, "embeddings").select(
            F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector")
        )
    )
    return W.output_similarity(outputs, vectors).select(
        "item_id", F.round("similarity", 5).alias("similarity")
    )


@check(
    "words_by_input_similarity",
    "T7 N5",
    "SELECT v.vec_id::VARCHAR AS word, round(" + _cos("v.embedding", "g.embedding")
    + ", 5) AS similarity FROM embeddings v, embeddings g WHERE g.vec_id = 0",
)
def words_by_input_similarity(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector")
    )
    out = W.sweep_by_input_similarity(vectors.select("word"), vectors, "0")
    return out.select("word", F.round("similarity", 5).alias("similarity"))


@check(
    "random_word_draws",
    "R5 R6 G24",
    lambda: "SELECT "
    + pick_word(PAIRS.random_words, 7, "p_partkey", "r_eng1")
    + " AS word, count(*) AS n FROM part GROUP BY 1",
)
def random_word_draws(spark, sf):
    number = draw_below(len(PAIRS.random_words), 7, F.col("p_partkey"), "r_eng1")
    word = F.get(F.array(*[F.lit(w) for w in PAIRS.random_words]), number)
    return table(spark, sf, "part").groupBy(word.alias("word")).agg(F.count("*").alias("n"))
