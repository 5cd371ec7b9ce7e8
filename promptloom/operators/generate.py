"""Item generation: one id in, one (prompt, CREATE TABLE, SQL) item out.

The whole job is a chain of projections over an id column. Nothing shuffles;
an id's item depends on (seed, id) alone, so lost partitions are recomputed to
the same rows and two clusters agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from promptloom.functions import names as N
from promptloom.functions.draws import (
    block_columns, chance, choice_width, digests, draw, draw_below, each, elements, held, hex_number, joined, let,
    numbers, pick_short, pick_word, rest, sample_array, sample_order, sample_start, sampled, sort_keys, with_computed, word_at,
)
from promptloom.functions.text import base_type
from promptloom.sources import schemas as S
from promptloom.sources.vocabulary import AGGREGATES, DEFAULT, Vocabulary

MAX_CONDITIONS = 3
MAX_JOIN_COLUMNS = 4


def empty_array(element: str) -> Column:
    return F.expr(f"cast(array() as array<{element}>)")


# ----------------------------------------------------------------------- vocabulary
def _spaced(synonyms: list) -> list:
    return [w.replace("_", " ") for w in synonyms]


def with_vocabulary(ids: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Adds the lists of the vocabulary, each the value of a one-row relation. They are looked up
    in the next projection; no row carries them further."""
    fields = [{"name": f[0], "types": list(f[1]), "synonyms": _spaced(f[2])} for f in vocab.fields]
    tables = [{"name": t[0], "synonyms": _spaced(t[1])} for t in vocab.tables]
    lists = {"fields": fields, "tables": tables, "templates": vocab.select_templates}
    lists |= {"asc": vocab.asc_phrases(), "desc": vocab.desc_phrases()}
    lists |= {agg: vocab.agg_phrases[agg] for agg in AGGREGATES}
    return ids.withColumns({f"_v_{name}": held(values) for name, values in lists.items()})


def without_vocabulary(items: DataFrame) -> DataFrame:
    return items.drop(*[c for c in items.columns if c.startswith("_v_")])


def lookup(name: str, number: str) -> str:
    """SQL text: the entry of a vocabulary list that a number falls on."""
    return f"get(_v_{name}, cast({number} % size(_v_{name}) as int))"


# ------------------------------------------------------------------ tables and fields
def table_lookup(prefix: str = "") -> dict[str, Column]:
    """Name of a table and one of its synonyms (underscores read as spaces)."""
    row = lookup("tables", f"_{prefix}tab")
    return {
        f"_{prefix}tname": F.expr(f"{row}.name"),
        f"_{prefix}tsynonym": F.expr(f"get({row}.synonyms, cast(_{prefix}tsyn % size({row}.synonyms) as int))"),
    }


def drawn_table(prefix: str = "") -> Column:
    """The table that was looked up. Catalyst prunes fields of structs that a generator gives, so
    ``with_computed`` gets its parts."""
    name, synonym = F.col(f"_{prefix}tname").alias("name"), F.col(f"_{prefix}tsynonym").alias("synonym")
    return F.struct(name, synonym, F.lit(False).alias("use_synonym"))


def field_draws(key, seed: int, vocab: Vocabulary, count: Column, bound: int, prefix: str = "") -> tuple[dict, dict]:
    """What :func:`field_lookup` reads: numbers drawn first, and numbers that read those."""
    start, step = sample_start(len(vocab.fields), seed, key, prefix + "field")
    first = {
        f"_{prefix}start": start,
        f"_{prefix}step": step,
        f"_{prefix}count": count,
        f"_{prefix}tab": draw(seed, key, prefix + "table"),
        f"_{prefix}tsyn": draw(seed, key, prefix + "table_syn"),
        **block_columns(seed, key, prefix + "field", bound),
    }
    return first, {f"_{prefix}field": numbers(seed, key, prefix + "field", bound, f"_{prefix}count")}


def field_lookup(vocab: Vocabulary, bound: int, prefix: str = "") -> Column:
    """Different vocabulary entries in drawn order, each with one type and one synonym.

    A field that has the table's name gets the ending ``_field``. Only the drawn type and synonym
    of an entry are copied, and nothing behind the last field of the table is looked up.
    """
    width = choice_width([f[1] for f in vocab.fields]).bit_length()  # see ``rest``
    table, parts = lookup("tables", f"_{prefix}tab"), []
    for k in range(bound):
        row = lookup("fields", f"(cast(_{prefix}start as bigint) + {k} * cast(_{prefix}step as bigint))")
        number = f"get(_{prefix}field, {k})"
        name = f"if({row}.name = {table}.name, concat({row}.name, '_field'), {row}.name)"
        kind = f"get({row}.types, cast({number} % size({row}.types) as int))"
        synonym = f"get({row}.synonyms, cast(shiftright({number}, {width}) % size({row}.synonyms) as int))"
        field = f"named_struct('name', {name}, 'type', {kind}, 'synonym', {synonym}, 'use_synonym', false)"
        parts.append(f"if({k} < _{prefix}count, {field}, null)")
    return F.expr(f"slice(array({', '.join(parts)}), 1, _{prefix}count)")


def first_of(values: Column, like: Column) -> Column:
    """As many values as ``like`` has elements."""
    return F.slice(values, F.lit(1), F.size(like))


def create_statement(table: Column, fields: Column, bound: int | None = None) -> Column:
    """``CREATE TABLE t ( a T, b T )``."""
    columns = _joined(", ", fields, bound, lambda f, k: F.concat(f["name"], F.lit(" "), f["type"]))
    return F.concat(F.lit("CREATE TABLE "), table["name"], F.lit(" ( "), columns, F.lit(" )"))


def _each(values: Column, bound: int | None, body) -> Column:
    """A text or struct per element; compiled where the most elements (``bound``) are known."""
    return F.transform(values, body) if bound is None else each(values, bound, body)


def _joined(separator: str, values: Column, bound: int | None, body) -> Column:
    if bound is None:
        return F.array_join(F.transform(values, body), separator)
    return joined(separator, values, bound, body)


def _paired(values: Column, others: Column, bound: int | None, body) -> Column:
    if bound is None:
        return F.zip_with(values, others, body)
    return each(values, bound, lambda v, k: body(v, F.get(others, F.lit(k))))


def with_join_side(items: DataFrame, seed: int, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Adds the table that set 5 joins and its fields, ``_join_table`` and ``_join_fields``, also
    where no pair of columns was found."""
    count = draw_below(MAX_JOIN_COLUMNS, seed, "item_id", "j_ncols") + 1
    first, draws = field_draws("item_id", seed, vocab, count, MAX_JOIN_COLUMNS, "j_")
    drawn = with_vocabulary(items.withColumns(first).withColumns(draws), vocab)
    found = {**table_lookup("j_"), "_join_fields": field_lookup(vocab, MAX_JOIN_COLUMNS, "j_")}
    return without_vocabulary(with_computed(drawn, found)).withColumn("_join_table", drawn_table("j_"))


# ------------------------------------------------------------------------- SELECT
def drawn_aggregate(sql_type: Column, number: Column, by_base_type: bool = False) -> Column:
    """An aggregate the type label admits. Labels match whole unless ``by_base_type``."""
    label = base_type(sql_type) if by_base_type else F.upper(sql_type)
    return (
        F.when(label.isin(N.NUMERIC_TYPES), word_at(N.NUMERIC_AGGREGATES, number))
        .when(label.isin(N.TEXT_TYPES + N.DATE_TYPES), word_at(N.ORDERED_AGGREGATES, number))
        .otherwise(word_at(N.DEFAULT_AGGREGATES, number))
    )


def clause_blocks(key, seed: int, bound: int, order_by: bool, where: bool) -> dict[str, Column]:
    """Numbers and digests that :func:`clause_draws` reads where it is told how many fields a row has."""
    slots, out = ["sel", "agg", "aphr"], {"_nsel": draw(seed, key, "nsel")}
    if order_by:
        slots, out = [*slots, "osel", "ophr"], out | {"_nord": draw(seed, key, "nord")}
    for slot in [*slots, *(["wsel"] if where else [])]:
        out |= block_columns(seed, key, slot, bound)
    return out


def clause_draws(key, seed: int, bound: int, order_by: bool, where: bool, fields: str | None = None) -> dict[str, Column]:
    """Numbers and sort keys the clauses of a row read; with ``fields`` (a column: how many fields the row has, next to
    :func:`clause_blocks`) only those that it reads."""
    chosen, ordered = (None if fields is None else f"(1 + {n} % {fields})" for n in ("_nsel", "_nord"))
    out = {
        "_sel": sort_keys(seed, key, "sel", bound, fields),
        "_agg": numbers(seed, key, "agg", bound, chosen),
        "_naphr": numbers(seed, key, "aphr", bound, chosen),
    }
    if order_by:
        out |= {
            "_osel": sort_keys(seed, key, "osel", bound, fields),
            "_odir": draw(seed, key, "odir"),
            "_nophr": numbers(seed, key, "ophr", bound, ordered),
        }
    if where:
        out |= {
            "_wsel": sort_keys(seed, key, "wsel", bound, fields),
            "_nwhere": draw(seed, key, "nwhere"),
            "_wval": digests(seed, key, "wval", MAX_CONDITIONS),
        }
    if fields is None:
        out |= {"_nsel": draw(seed, key, "nsel")} | ({"_nord": draw(seed, key, "nord")} if order_by else {})
    return out


def phrase_lookups(bound: int, order_by: bool) -> dict[str, Column]:
    """For each drawn number the phrase of every aggregate, and of both directions; NULL for none."""

    def all_of(numbers: str, names: dict[str, str]) -> Column:
        rows = []
        for k in range(bound):
            row = ", ".join(f"{lookup(v, f'{numbers}[{k}]')} as `{a}`" for a, v in names.items())
            rows.append(f"if({numbers}[{k}] is null, null, struct({row}))")
        return F.expr("array(" + ", ".join(rows) + ")")

    out = {"_aphr": all_of("_naphr", {agg: agg for agg in AGGREGATES})}
    if order_by:
        out["_ophr"] = all_of("_nophr", {"asc": "asc", "desc": "desc"})
    return out


def drawn_count(number: Column, most: Column) -> Column:
    """1 .. most."""
    return (1 + number % most).cast("int")


def draw_select(
    fields: Column, use_aggregates: bool, use_synonyms: bool, by_base_type: bool = False, bound: int | None = None
) -> Column:
    """1..n of the table's fields, in drawn order, each with an aggregate or none.

    A field reads as its synonym with probability one half.
    """

    def one(f: Column, n: Column) -> Column:
        aggregate = drawn_aggregate(f["type"], rest(n, 1), by_base_type)
        return F.struct(
            f["name"].alias("name"),
            (aggregate if use_aggregates else F.lit("")).alias("aggregate"),
            f["synonym"].alias("synonym"),
            (n % 2 == 0 if use_synonyms else F.lit(False)).alias("use_synonym"),
        )

    count = drawn_count(F.col("_nsel"), F.size(fields))
    if bound is not None:
        order = sample_order(fields, F.col("_sel"), count)
        return each(order, bound, lambda key, k: one(sampled(fields, key), F.get("_agg", F.lit(k))))
    chosen = sample_array(fields, F.col("_sel"), count)
    return F.zip_with(chosen, F.slice("_agg", F.lit(1), count), one)


def select_sql(table: Column, select: Column, bound: int | None = None) -> Column:
    return F.concat(
        F.lit("SELECT "),
        _joined(", ", select, bound, N.select_text if bound is None else lambda f, k: N.select_text(f)),
        F.lit(" FROM "),
        table["name"],
    )


def draw_agg_phrases(select: Column, bound: int | None = None) -> Column:
    """One phrase per select field, NULL where the field has no aggregate."""

    def one(f: Column, phrases: Column) -> Column:
        return F.coalesce(*[F.when(f["aggregate"] == agg, phrases[agg]) for agg in AGGREGATES])

    return _paired(select, first_of(F.col("_aphr"), select) if bound is None else F.col("_aphr"), bound, one)


def spoken_fields(select: Column, phrases: Column, bound: int | None = None) -> Column:
    """The fields as they are said, each behind its phrase if it has one."""
    if bound is not None:
        words = [F.concat_ws(" ", F.get(phrases, F.lit(k)), N.display_name(f)) for k, f in enumerate(elements(select, bound))]
        inner = [F.when(F.size(select) > k + 1, w) for k, w in enumerate(words[:-1])]
        last = F.coalesce(*[F.when(F.size(select) == k + 1, w) for k, w in enumerate(words)])
        head = F.concat(F.concat_ws(", ", *inner), F.lit(" and ")) if inner else F.lit("")
        return F.concat(F.when(F.size(select) > 1, head).otherwise(F.lit("")), last)
    words = F.zip_with(select, phrases, lambda f, p: F.concat_ws(" ", p, N.display_name(f)))
    return let(
        words,
        lambda w: F.concat(
            F.when(
                F.size(w) > 1,
                F.concat(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), ", "), F.lit(" and ")),
            ).otherwise(F.lit("")),
            F.get(w, F.size(w) - 1),
        ),
    )


def english_select(
    template: Column, table: Column, select: Column, phrases: Column, bound: int | None = None
) -> Column:
    """The template with the spoken field list and the table."""
    text = F.replace(template, F.lit("[fields]"), spoken_fields(select, phrases, bound))
    return F.replace(text, F.lit("[table]"), N.display_name(table))


# ------------------------------------------------------------------------ ORDER BY
def draw_order(fields: Column, bound: int | None = None) -> Column:
    """1..n fields in drawn order, one direction for all of them."""
    order = sample_order(fields, F.col("_osel"), drawn_count(F.col("_nord"), F.size(fields)))

    def one(key: Column, k) -> Column:
        return F.struct(sampled(fields, key)["name"].alias("name"), (F.col("_odir") % 2 == 1).alias("asc"))

    return _each(order, bound, one)


def order_sql(order: Column, bound: int | None = None) -> Column:
    """``ORDER BY a ASC, b ASC``; empty text for an empty list."""

    def one(f: Column, k) -> Column:
        return F.concat(f["name"], F.when(f["asc"], F.lit(" ASC")).otherwise(F.lit(" DESC")))

    return F.when(F.size(order) < 1, F.lit("")).otherwise(
        F.concat(F.lit("ORDER BY "), _joined(", ", order, bound, one))
    )


def draw_order_phrases(order: Column, bound: int | None = None) -> Column:
    """One phrase of the field's direction per order field."""
    phrases = first_of(F.col("_ophr"), order) if bound is None else F.col("_ophr")
    return _paired(order, phrases, bound, lambda f, p: F.when(f["asc"], p["asc"]).otherwise(p["desc"]))


def english_order(order: Column, phrases: Column, bound: int | None = None) -> Column:
    """`` phrase a, phrase b`` with its leading space; empty text for an empty list."""
    if bound is not None:
        return joined(
            ",", order, bound, lambda f, k: F.concat(F.lit(" "), F.get(phrases, F.lit(k)), F.lit(" "), f["name"])
        )
    parts = F.zip_with(
        order, phrases, lambda f, p: F.concat(F.lit(" "), p, F.lit(" "), f["name"])
    )
    return F.array_join(parts, ",")


# --------------------------------------------------------------------------- WHERE
def draw_literal(kind: Column, hex_text: Column) -> Column:
    """A literal for a base type, from the digits of one md5."""
    a, b, c = (hex_number(hex_text, start) for start in (1, 9, 17))
    date = F.concat(
        F.lit("'"),
        (2000 + a % 24).cast("string"),
        F.lit("-"),
        F.lpad((1 + b % 12).cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad((1 + c % 28).cast("string"), 2, "0"),
        F.lit("'"),
    )
    json = F.concat(
        F.lit("'{\""), word_at(N.JSON_WORDS, a), F.lit('": "'), word_at(N.JSON_WORDS, b),
        F.lit("\"}'"),
    )
    uuid = F.concat(
        F.lit("'"), F.substring(hex_text, 1, 8), F.lit("-"), F.substring(hex_text, 9, 4),
        F.lit("-4"), F.substring(hex_text, 14, 3), F.lit("-a"), F.substring(hex_text, 18, 3),
        F.lit("-"), F.substring(hex_text, 21, 12), F.lit("'"),
    )
    return (
        F.when(kind.isin(N.TEXT_TYPES), F.concat(F.lit("'%"), F.chr(97 + a % 26), F.lit("%'")))
        .when(kind.isin(N.DATE_TYPES), date)
        .when(kind == "BOOLEAN", F.when(a % 2 == 0, F.lit("TRUE")).otherwise(F.lit("FALSE")))
        .when(kind == "UUID", uuid)
        .when(
            kind == "BLOB", F.concat(F.lit("x'"), F.upper(F.substring(hex_text, 1, 8)), F.lit("'"))
        )
        .when(kind.isin("JSON", "JSONB"), json)
        .otherwise((1 + a % 100).cast("string"))
    )


def drawn_operator(kind: Column, number: Column) -> Column:
    """A comparison operator the base type admits."""
    return (
        F.when(kind.isin(N.NUMERIC_TYPES + N.DATE_TYPES), word_at(N.RANGE_OPERATORS, number))
        .when(kind.isin(N.TEXT_TYPES), F.lit("LIKE"))
        .otherwise(F.lit("="))
    )


def draw_conditions(fields: Column, max_conditions: int = MAX_CONDITIONS) -> Column:
    """1..min(max, n) conditions: array of (field, operator, literal)."""

    def one(f: Column, hex_text: Column) -> Column:
        # The literal uses the first three numbers of the md5, the operator the last.
        kind = base_type(f["type"])
        return F.struct(
            f.alias("field"),
            drawn_operator(kind, hex_number(hex_text, 25)).alias("operator"),
            draw_literal(kind, hex_text).alias("literal"),
        )

    most = F.least(F.lit(max_conditions), F.size(fields))
    count = drawn_count(F.col("_nwhere"), most)
    chosen = sample_array(fields, F.col("_wsel"), count)
    return F.zip_with(chosen, F.slice("_wval", F.lit(1), count), one)


def condition_text(c: Column) -> Column:
    return F.concat(c["field"]["name"], F.lit(" "), c["operator"], F.lit(" "), c["literal"])


def where_sql(conditions: Column) -> Column:
    """``WHERE a = 1 AND b LIKE '%c%'``; empty text for an empty list."""
    return F.when(F.size(conditions) < 1, F.lit("")).otherwise(
        F.concat(F.lit("WHERE "), F.array_join(F.transform(conditions, condition_text), " AND "))
    )


def english_where(conditions: Column) -> Column:
    """``where a is equal to 1 and ...``; empty text for an empty list."""

    def words(operator: Column) -> Column:
        spoken = [F.when(operator == op, F.lit(text)) for op, text in N.OPERATOR_WORDS.items()]
        return F.coalesce(*spoken, operator)

    parts = F.transform(
        conditions,
        lambda c: F.concat(
            c["field"]["name"], F.lit(" is "), words(c["operator"]), F.lit(" "), c["literal"]
        ),
    )
    return F.when(F.size(conditions) < 1, F.lit("")).otherwise(
        F.concat(F.lit("where "), F.array_join(parts, " and "))
    )


# ---------------------------------------------------------------------------- JOIN
def equal_type_pairs(main: Column, other: Column) -> Column:
    """All (main, joined) column pairs with the same base type, main column first."""

    def typed(fields: Column) -> Column:
        return F.transform(
            fields, lambda f: F.struct(base_type(f["type"]).alias("t"), f.alias("f"))
        )

    def pairs_of(m: Column, others: Column) -> Column:
        return F.transform(
            F.filter(others, lambda j: j["t"] == m["t"]),
            lambda j: F.struct(m["f"].alias("main"), j["f"].alias("joined")),
        )

    return let(
        typed(other), lambda js: F.flatten(F.transform(typed(main), lambda m: pairs_of(m, js)))
    )


def join_sql(table: Column, other: Column, pair: Column) -> Column:
    """``JOIN u ON t.a = u.b``; NULL without a pair."""
    return F.concat(
        F.lit("JOIN "), other["name"], F.lit(" ON "), table["name"], F.lit("."),
        pair["main"]["name"], F.lit(" = "), other["name"], F.lit("."), pair["joined"]["name"],
    )


def english_join(other: Column, pair: Column) -> Column:
    """``join with u on a equals b``; NULL without a pair."""
    return F.concat(
        F.lit("join with "), N.display_name(other), F.lit(" on "), pair["main"]["name"],
        F.lit(" equals "), pair["joined"]["name"],
    )


# --------------------------------------------------------------------- command sets
def generate_items(ids: DataFrame, csn: int, seed: int = 7, **options) -> DataFrame:
    """Items of one command set (1 select, 2 order by, 3 aggregates, 4 where, 5 join); see :func:`generate_sets`."""
    return generate_sets(ids, (csn,), seed, **options)


def generate_sets(
    ids: DataFrame,
    csns: tuple[int, ...],
    seed: int = 7,
    *,
    id_col: str = "item_id",
    total: int | None = None,
    order_by_probability: float = 0.9,
    where_probability: float = 0.9,
    use_aggregates: bool = False,
    min_cols: int = 2,
    max_cols: int = 12,
    use_synonyms_table: bool = False,
    use_synonyms_field: bool = False,
    aggregates_by_base_type: bool = False,
    vocab: Vocabulary = DEFAULT,
    columns: tuple[str, ...] = tuple(S.ITEM_COLUMNS),
) -> DataFrame:
    """Items of several command sets, one item per id and set. Sets draw the same numbers for an id, so
    they share its table and clauses, and each set is a row made from them in place.

    Sets 2-4 place ORDER BY on the first ``order_by_probability`` of the rows by
    index when ``total`` is given (ids 0 .. total-1), else by a draw per row; set 5
    always draws. ``use_aggregates`` reaches set 2 only; set 3 always has them.
    """
    if not csns or any(csn not in (1, 2, 3, 4, 5) for csn in csns):
        raise ValueError(f"unknown command set: {csns}")
    if not 1 <= min_cols <= max_cols <= len(vocab.fields):
        raise ValueError("need 1 <= min_cols <= max_cols <= number of fields")
    top = max(csns)
    with_aggregates = {csn: csn == 3 or (csn == 2 and use_aggregates) for csn in csns}
    key, table, fields = "item_id", F.col("_table"), F.col("table_fields")
    count = draw_below(max_cols - min_cols + 1, seed, key, "ncols") + min_cols

    # All numbers a row draws, what they fall on in the vocabulary, then its table; the clauses
    # read finished columns.
    first, draws = field_draws(key, seed, vocab, count, max_cols)
    first |= clause_blocks(key, seed, max_cols, order_by=top > 1, where=top > 3)
    draws |= clause_draws(key, seed, max_cols, order_by=top > 1, where=top > 3, fields="_count")
    draws["_ntpl"] = draw(seed, key, "tpl")
    found = {
        **table_lookup(),
        "table_fields": field_lookup(vocab, max_cols),
        "_template": F.expr(lookup("templates", "_ntpl")),
        **phrase_lookups(max_cols, top > 1),
    }
    if top == 5:
        other_count = draw_below(MAX_JOIN_COLUMNS, seed, key, "j_ncols") + 1
        draws["_j_pair"] = draw(seed, key, "j_pair")
        for mine, own in zip((first, draws), field_draws(key, seed, vocab, other_count, MAX_JOIN_COLUMNS, "j_")):
            mine |= own
        found |= {**table_lookup("j_"), "_join_fields": field_lookup(vocab, MAX_JOIN_COLUMNS, "j_")}
    drawn = with_vocabulary(ids.select(F.col(id_col).alias("item_id")).withColumns(first).withColumns(draws), vocab)
    items = without_vocabulary(with_computed(drawn, found)).withColumn("_table", drawn_table())
    if top == 5:
        items = items.withColumn("_join_table", drawn_table("j_"))

    # Clauses: each draws from the table's own fields.
    as_synonym = draw_below(10, seed, key, "use_tsyn") < 8 if use_synonyms_table else F.lit(False)
    kinds = sorted(set(with_aggregates.values()))
    clauses = {
        "create_statement": create_statement(table, fields),
        "table_name": F.struct(
            table["name"].alias("name"),
            table["synonym"].alias("synonym"),
            as_synonym.alias("use_synonym"),
        ),
    }
    for rich in kinds:
        clauses[f"_select_{rich}"] = draw_select(fields, rich, use_synonyms_field, aggregates_by_base_type)
    by_index = {csn: total is not None and csn != 5 for csn in csns if csn > 1}
    for indexed in sorted(set(by_index.values())):
        has_order = (
            F.col("item_id") < F.lit(total * order_by_probability)
            if indexed
            else chance(order_by_probability, seed, key, "has_order")
        )
        clauses[f"_order_{indexed}"] = F.when(has_order, draw_order(fields)).otherwise(empty_array(S.ORDER))
    if top >= 4:
        kind = f"struct<field:{S.FIELD},operator:string,literal:string>"
        clauses["_conditions"] = F.when(
            chance(where_probability, seed, key, "has_where"), draw_conditions(fields)
        ).otherwise(empty_array(kind))
    if top == 5:
        clauses["_pairs"] = equal_type_pairs(fields, F.col("_join_fields"))
    items = items.withColumns(clauses)

    # Phrases and the join pair, drawn once the clauses stand.
    phrases, conditions = {}, F.col("_conditions")
    for rich in kinds:
        select = F.col(f"_select_{rich}")
        none = F.array_repeat(F.lit(None).cast("string"), F.size(select))
        phrases[f"_agg_all_{rich}"] = draw_agg_phrases(select) if rich else none
    for indexed in set(by_index.values()):
        phrases[f"_order_phrase_{indexed}"] = draw_order_phrases(F.col(f"_order_{indexed}"))
    if top == 5:
        pairs = F.col("_pairs")
        place = F.col("_j_pair") % F.greatest(F.size(pairs), F.lit(1))
        phrases["_join_condition"] = F.get(pairs, place.cast("int"))
    items = items.withColumns(phrases)

    # Texts of the clauses, then those of the sets.
    texts = {}
    for rich in kinds:
        select = F.col(f"_select_{rich}")
        texts[f"_said_{rich}"] = english_select(F.col("_template"), F.col("table_name"), select, F.col(f"_agg_all_{rich}"))
        texts[f"_written_{rich}"] = select_sql(table, select)
    for indexed in set(by_index.values()):
        order = F.col(f"_order_{indexed}")
        texts[f"_said_order_{indexed}"] = english_order(order, F.col(f"_order_phrase_{indexed}"))
        texts[f"_written_order_{indexed}"] = order_sql(order)
    if top >= 4:
        texts |= {"_said_where": english_where(conditions), "_written_where": where_sql(conditions)}
    items = items.withColumns(texts)
    rows = {}
    for csn in csns:
        made = _set_columns(csn, with_aggregates[csn], by_index.get(csn))
        rows[csn] = [made.get(name, F.col(name)).alias(name) for name in columns]
    if len(rows) == 1:
        return items.select(*rows[csns[0]])
    # A generator interprets what it holds, so the rows are columns before.
    sets = items.withColumns({f"_set{csn}": F.struct(*row) for csn, row in rows.items()})
    return sets.select(F.inline(F.array(*[f"_set{csn}" for csn in rows])))


def _set_columns(csn: int, rich: bool, indexed: bool | None) -> dict[str, Column]:
    """The columns of one set's item, from the clauses that sets share. Double spaces and the trailing
    space of sets 2/3 without ORDER BY stay."""
    conditions, space = F.col("_conditions"), F.lit(" ")
    english, sql = F.col(f"_said_{rich}"), F.col(f"_written_{rich}")
    if csn in (2, 3):
        english = F.concat(english, space, F.col(f"_said_order_{indexed}"))
        sql = F.concat(sql, space, F.col(f"_written_order_{indexed}"))
    elif csn >= 4:
        spoken = [F.col("_said_where"), F.col(f"_said_order_{indexed}")]
        written = [F.col("_written_where"), F.col(f"_written_order_{indexed}")]
        if csn == 5:
            pair, other = F.col("_join_condition"), F.col("_join_table")
            spoken.insert(0, F.coalesce(english_join(other, pair), F.lit("")))
            written.insert(0, F.coalesce(join_sql(F.col("_table"), other, pair), F.lit("")))
        english = F.trim(F.concat_ws(" ", english, *spoken))
        sql = F.trim(F.concat_ws(" ", sql, *written))

    no_texts = F.lit(None).cast("array<string>")
    final = {
        "source_csn": F.lit(csn),
        "command_set": F.lit(2 if csn == 3 else csn),
        "select": F.col(f"_select_{rich}"),
        "order_by": F.col(f"_order_{indexed}") if csn > 1 else F.lit(None).cast(f"array<{S.ORDER}>"),
        "order_by_phrase": F.col(f"_order_phrase_{indexed}") if csn > 1 else no_texts,
        "agg_phrases": F.filter(F.col(f"_agg_all_{rich}"), lambda p: p.isNotNull()),
        "english_prompt": english,
        "sql_statement": sql,
        "where": F.transform(conditions, condition_text) if csn >= 4 else no_texts,
    }
    if csn == 5:
        found = F.col("_join_condition").isNotNull()
        other, other_fields = F.col("_join_table"), F.col("_join_fields")
        return final | {
            "where_fields": conditions["field"],
            "where_literals": conditions["literal"],
            "join_table": F.when(found, other),
            "join_fields": F.when(found, other_fields).otherwise(empty_array(S.FIELD)),
            "join_condition": F.col("_join_condition"),
            "join_create_statement": F.when(found, create_statement(other, other_fields)),
        }
    return final | {
        "where_fields": F.lit(None).cast(f"array<{S.FIELD}>"),
        "where_literals": no_texts,
        "join_table": F.lit(None).cast(S.TABLE),
        "join_fields": F.lit(None).cast(f"array<{S.FIELD}>"),
        "join_condition": F.lit(None).cast(S.PAIR),
        "join_create_statement": F.lit(None).cast("string"),
    }


def generate_range(spark: SparkSession, n: int, csn: int, seed: int = 7, **options) -> DataFrame:
    """``n`` items with ids 0 .. n-1; ORDER BY follows the index rule."""
    return generate_items(spark.range(n), csn, seed, id_col="id", total=n, **options)


def generate_all_sets(ids: DataFrame, seed: int = 7, **options) -> DataFrame:
    """Items of all five command sets, one item per id and set."""
    return generate_sets(ids, (1, 2, 3, 4, 5), seed, **options)


def seed_columns(
    ids: DataFrame, categories: dict[str, list[str]], seed: int = 7, id_col: str = "item_id"
) -> DataFrame:
    """One drawn value per categorical seed column and record."""
    return ids.withColumns(
        {n: pick_word(words, seed, F.col(id_col), "seed_" + n) for n, words in categories.items()}
    )


def draw_aggregate_phrase(key, seed: int, vocab: Vocabulary = DEFAULT, slot: str = "agg_or_none") -> Column:
    """(aggregate or none, phrase), drawn over the five aggregates and none."""
    aggregate = pick_short([*AGGREGATES, ""], seed, key, slot)
    phrases = [
        F.when(aggregate == agg, pick_word(vocab.agg_phrases[agg], seed, key, slot + "_phrase"))
        for agg in AGGREGATES
    ]
    return F.struct(aggregate.alias("aggregate"), F.coalesce(*phrases, F.lit("")).alias("phrase"))
