"""The item generators once more, as DuckDB SQL over the same vocabularies.

Written with list functions, so that one relation ``items`` can be put in front of
any check query: ``WITH <items_ctes(...)> SELECT ... FROM items``.
"""

from __future__ import annotations

from promptloom.functions import names as N
from promptloom.functions.draws import strides
from promptloom.sources.vocabulary import AGGREGATES, DEFAULT, Vocabulary


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ",".join(lit(v) for v in values) + "]"


def md5_of(seed: int, key: str, *slot: str) -> str:
    return f"md5('{seed}:' || {key} || " + lit("".join(":" + s for s in slot)) + ")"


def hex_number(text: str) -> str:
    return f"('0x' || {text})::BIGINT"


def draw(seed: int, key: str, slot: str) -> str:
    return hex_number(f"substr({md5_of(seed, key, slot)}, 1, 8)")


def draw_below(n, seed: int, key: str, slot: str) -> str:
    return f"({draw(seed, key, slot)} % {n})"


def chance(p: float, seed: int, key: str, slot: str) -> str:
    return f"({draw_below(1_000_000, seed, key, slot)} < {round(p * 1_000_000)})"


def word_at(values, number: str) -> str:
    return f"({words(values)})[({number}) % {len(values)} + 1]"


def pick_word(values, seed: int, key: str, slot: str) -> str:
    return word_at(values, draw(seed, key, slot))


def digits(seed: int, key: str, slot: str, count: int) -> str:
    return "(" + " || ".join(md5_of(seed, key, slot, str(j)) for j in range((count + 3) // 4)) + ")"


def number_at(block: str, k: str) -> str:
    return hex_number(f"substr({block}, ({k}) * 8 + 1, 8)")


def order_of(count: str, block: str) -> str:
    """Zero-based indices in drawn order."""
    keys = (
        f"list_transform(range({count}), "
        f"lambda k: substr({block}, k * 8 + 1, 8) || lpad(k::VARCHAR, 3, '0'))"
    )
    return f"list_transform(list_sort({keys}), lambda q: substr(q, 9, 3)::BIGINT)"


def sample(values: str, count: str, block: str) -> str:
    return (
        f"list_transform(list_slice({order_of(f'len({values})', block)}, 1, {count}), "
        f"lambda p: {values}[p + 1])"
    )


def base_type(t: str) -> str:
    return f"split_part(upper({t}), '(', 1)"


def choice(rows, at: str, number: str) -> str:
    """The word list of row ``at``, indexed by the number."""
    table = "[" + ",".join(words(r) for r in rows) + "]"
    return f"list_extract(({table})[{at} + 1], (({number}) % len(({table})[{at} + 1])) + 1)"


def rest(number: str, divisor: int) -> str:
    return f"(({number}) >> {divisor.bit_length()})"


class Choices:
    """Word lists repeated to one width, like the generator lays them out."""

    def __init__(self, rows):
        from math import lcm

        self.width = lcm(*[len(r) for r in rows])
        self.flat = words([r[i % len(r)] for r in rows for i in range(self.width)])

    def at(self, row: str, number: str) -> str:
        return f"({self.flat})[({row}) * {self.width} + ({number}) % {self.width} + 1]"


def table_struct(key: str, seed: int, vocab: Vocabulary, prefix: str = "") -> str:
    at = draw_below(len(vocab.tables), seed, key, prefix + "table")
    synonyms = Choices([[s.replace("_", " ") for s in t[1]] for t in vocab.tables])
    return (
        f"{{'name': ({words([t[0] for t in vocab.tables])})[{at} + 1], "
        f"'synonym': {synonyms.at(at, draw(seed, key, prefix + 'table_syn'))}, "
        f"'use_synonym': false}}"
    )


def fields_list(
    key: str, seed: int, vocab: Vocabulary, table: str, count: str, bound: int, prefix: str = ""
) -> str:
    n = len(vocab.fields)
    steps = strides(n)
    types = Choices([f[1] for f in vocab.fields])
    synonyms = Choices([[s.replace("_", " ") for s in f[2]] for f in vocab.fields])
    step = f"([{','.join(map(str, steps))}])[{draw_below(len(steps), seed, key, prefix + 'field_stride')} + 1]"
    at = f"(({draw_below(n, seed, key, prefix + 'field_start')} + k * {step}) % {n})"
    number = number_at(digits(seed, key, prefix + "field", bound), "k")
    name = f"({words([f[0] for f in vocab.fields])})[{at} + 1]"
    return (
        f"list_transform(range({count}), lambda k: {{"
        f"'name': CASE WHEN {name} = {table}.name THEN {name} || '_field' ELSE {name} END, "
        f"'type': {types.at(at, number)}, "
        f"'synonym': {synonyms.at(at, rest(number, types.width))}, 'use_synonym': false}})"
    )


def create_text(table: str, fields: str) -> str:
    return (
        f"'CREATE TABLE ' || {table}.name || ' ( ' || "
        f"array_to_string(list_transform({fields}, lambda f: f.name || ' ' || f.type), ', ') || ' )'"
    )


def type_in(t: str, kinds) -> str:
    return f"{t} IN ({','.join(lit(k) for k in kinds)})"


def literal_of(kind: str, block: str, k: str) -> str:
    a, b, c = (number_at(block, f"{k} * 4 + {i}") for i in range(3))
    h = f"substr({block}, {k} * 32 + 1, 32)"
    return (
        f"CASE WHEN {type_in(kind, N.TEXT_TYPES)} THEN '''%' || chr((97 + {a} % 26)::INT) || '%''' "
        f"WHEN {type_in(kind, N.DATE_TYPES)} THEN '''' || (2000 + {a} % 24) || '-' || "
        f"lpad((1 + {b} % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + {c} % 28)::VARCHAR, 2, '0') || '''' "
        f"WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {a} % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END "
        f"WHEN {kind} = 'UUID' THEN '''' || substr({h},1,8) || '-' || substr({h},9,4) || '-4' || "
        f"substr({h},14,3) || '-a' || substr({h},18,3) || '-' || substr({h},21,12) || '''' "
        f"WHEN {kind} = 'BLOB' THEN 'x''' || upper(substr({h},1,8)) || '''' "
        f"WHEN {type_in(kind, ['JSON', 'JSONB'])} THEN '''{{\"' || {word_at(N.JSON_WORDS, a)} || "
        f"'\": \"' || {word_at(N.JSON_WORDS, b)} || '\"}}''' "
        f"ELSE (1 + {a} % 100)::VARCHAR END"
    )


def alias_text(f: str) -> str:
    return f"{f}.aggregate || '_' || {f}.name"


def agg_text(f: str) -> str:
    return f"CASE WHEN {f}.aggregate = '' THEN {f}.name ELSE {f}.aggregate || '(' || {f}.name || ')' END"


def shown(f: str) -> str:
    return f"CASE WHEN {f}.use_synonym THEN {f}.synonym ELSE {f}.name END"


def items_ctes(
    csn: int,
    *,
    ids: str = "SELECT o_orderkey AS item_id FROM orders",
    seed: int = 7,
    total: str | None = None,
    order_p: float = 0.9,
    where_p: float = 0.9,
    syn_table: bool = False,
    syn_field: bool = False,
    min_cols: int = 2,
    max_cols: int = 12,
    use_aggregates: bool = False,
    by_base_type: bool = False,
    vocab: Vocabulary = DEFAULT,
    name: str = "items",
) -> str:
    """CTEs that end in a relation ``name`` with the columns of ``generate_items``."""
    key, p = "item_id", name + "_"
    agg = csn == 3 or (csn == 2 and use_aggregates)
    count = f"{draw_below(max_cols - min_cols + 1, seed, key, 'ncols')} + {min_cols}"
    s0 = f"SELECT item_id, {table_struct(key, seed, vocab)} AS tbl FROM ({ids})"
    s1 = f"SELECT *, {fields_list(key, seed, vocab, 'tbl', count, max_cols)} AS table_fields"
    if csn == 5:
        s1 += f", {table_struct(key, seed, vocab, 'j_')} AS jt"
    s1 += f" FROM {p}0"

    label = base_type("f.type") if by_base_type else "upper(f.type)"
    n_sel = number_at("sel_block", "k - 1")
    drawn = rest(n_sel, 1)
    aggregate = (
        f"CASE WHEN {type_in(label, N.NUMERIC_TYPES)} THEN {word_at(N.NUMERIC_AGGREGATES, drawn)} "
        f"WHEN {type_in(label, N.TEXT_TYPES + N.DATE_TYPES)} "
        f"THEN {word_at(N.ORDERED_AGGREGATES, drawn)} "
        f"ELSE {word_at(N.DEFAULT_AGGREGATES, drawn)} END"
        if agg
        else "''"
    )
    use = f"{n_sel} % 2 = 0" if syn_field else "false"
    blocks = {
        "sel_block": digits(seed, key, "agg", max_cols),
        "sel_rows": sample(
            "table_fields",
            f"1 + {draw_below('len(table_fields)', seed, key, 'nsel')}",
            digits(seed, key, "sel", max_cols),
        ),
        "aphr_block": digits(seed, key, "aphr", max_cols),
        "ophr_block": digits(seed, key, "ophr", max_cols),
        "wval_block": digits(seed, key, "wval", 12),
    }
    if csn > 1:
        has = f"item_id < {total} * {order_p}" if total and csn != 5 else chance(order_p, seed, key, "has_order")
        rows = sample(
            "table_fields",
            f"1 + {draw_below('len(table_fields)', seed, key, 'nord')}",
            digits(seed, key, "osel", max_cols),
        )
        blocks["ord_rows"] = f"CASE WHEN {has} THEN {rows} ELSE [] END"
    if csn >= 4:
        rows = sample(
            "table_fields",
            f"1 + {draw_below('least(3, len(table_fields))', seed, key, 'nwhere')}",
            digits(seed, key, "wsel", max_cols),
        )
        blocks["whr_rows"] = f"CASE WHEN {chance(where_p, seed, key, 'has_where')} THEN {rows} ELSE [] END"
    if csn == 5:
        blocks["jf"] = fields_list(key, seed, vocab, "jt", f"{draw_below(4, seed, key, 'j_ncols')} + 1", 4, "j_")
    s2 = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in blocks.items()) + f" FROM {p}1"

    cols = {
        "select_fields": (
            f"list_transform(sel_rows, lambda f, k: {{'name': f.name, 'aggregate': {aggregate}, "
            f"'synonym': f.synonym, 'use_synonym': {use}}})"
        ),
        "table_name": (
            "{'name': tbl.name, 'synonym': tbl.synonym, 'use_synonym': "
            + (f"{draw_below(10, seed, key, 'use_tsyn')} < 8" if syn_table else "false")
            + "}"
        ),
    }
    if csn > 1:
        cols["order_by"] = (
            "list_transform(ord_rows, lambda f: {'name': f.name, 'asc': "
            f"{draw_below(2, seed, key, 'odir')} = 1}})"
        )
    if csn >= 4:
        kind = base_type("f.type")
        op = number_at("wval_block", "(k - 1) * 4 + 3")
        cols["conditions"] = (
            "list_transform(whr_rows, lambda f, k: {'field': f, 'operator': "
            f"CASE WHEN {type_in(kind, N.NUMERIC_TYPES + N.DATE_TYPES)} THEN {word_at(N.RANGE_OPERATORS, op)} "
            f"WHEN {type_in(kind, N.TEXT_TYPES)} THEN 'LIKE' ELSE '=' END, "
            f"'literal': {literal_of(kind, 'wval_block', '(k - 1)')}}})"
        )
    if csn == 5:
        cols["pairs"] = (
            "flatten(list_transform(table_fields, lambda m: list_transform(list_filter(jf, "
            f"lambda j: {base_type('j.type')} = {base_type('m.type')}), "
            "lambda j: {'main': m, 'joined': j})))"
        )
    s3 = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in cols.items()) + f" FROM {p}2"

    phrase = (
        "CASE "
        + " ".join(
            f"WHEN f.aggregate = '{a}' THEN {word_at(vocab.agg_phrases[a], number_at('aphr_block', 'k - 1'))}"
            for a in AGGREGATES
        )
        + " END"
    )
    cols = {"agg_all": f"list_transform(select_fields, lambda f, k: {phrase})"}
    if csn > 1:
        n = number_at("ophr_block", "k - 1")
        cols["order_by_phrase"] = (
            f"list_transform(order_by, lambda f, k: CASE WHEN f.asc THEN {word_at(vocab.asc_phrases(), n)} "
            f"ELSE {word_at(vocab.desc_phrases(), n)} END)"
        )
    if csn == 5:
        cols["pair"] = f"pairs[{draw_below('greatest(len(pairs), 1)', seed, key, 'j_pair')} + 1]"
    cols["create_statement"] = create_text("tbl", "table_fields")
    s4 = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in cols.items()) + f" FROM {p}3"

    spoken = (
        "list_transform(select_fields, lambda f, k: "
        f"CASE WHEN agg_all[k] IS NULL THEN '' ELSE agg_all[k] || ' ' END || {shown('f')})"
    )
    s5 = f"SELECT *, {spoken} AS spoken FROM {p}4"
    fields_said = (
        "CASE WHEN len(spoken) > 1 THEN array_to_string(list_slice(spoken, 1, len(spoken) - 1), ', ') "
        "|| ' and ' ELSE '' END || spoken[len(spoken)]"
    )
    english = (
        f"replace(replace({pick_word(vocab.select_templates, seed, key, 'tpl')}, '[fields]', {fields_said}), "
        f"'[table]', {shown('table_name')})"
    )
    sql = (
        "'SELECT ' || array_to_string(list_transform(select_fields, lambda f: CASE WHEN f.aggregate = '' "
        f"THEN f.name ELSE {agg_text('f')} || ' AS ' || {alias_text('f')} END), ', ') || ' FROM ' || tbl.name"
    )
    if csn > 1:
        order_sql = (
            "CASE WHEN len(order_by) = 0 THEN '' ELSE 'ORDER BY ' || array_to_string(list_transform(order_by, "
            "lambda f: f.name || CASE WHEN f.asc THEN ' ASC' ELSE ' DESC' END), ', ') END"
        )
        order_en = (
            "coalesce(array_to_string(list_transform(order_by, lambda f, k: ' ' || order_by_phrase[k] || ' ' "
            "|| f.name), ','), '')"
        )
    if csn >= 4:
        where_sql = (
            "CASE WHEN len(conditions) = 0 THEN '' ELSE 'WHERE ' || array_to_string(list_transform(conditions, "
            "lambda c: c.field.name || ' ' || c.operator || ' ' || c.literal), ' AND ') END"
        )
        said = " ".join(f"WHEN '{op}' THEN '{text}'" for op, text in N.OPERATOR_WORDS.items())
        where_en = (
            "CASE WHEN len(conditions) = 0 THEN '' ELSE 'where ' || array_to_string(list_transform(conditions, "
            f"lambda c: c.field.name || ' is ' || CASE c.operator {said} END || ' ' || c.literal), ' and ') END"
        )
    if csn in (2, 3):
        english, sql = f"{english} || ' ' || {order_en}", f"{sql} || ' ' || {order_sql}"
    elif csn == 4:
        english = f"trim({english} || ' ' || {where_en} || ' ' || {order_en})"
        sql = f"trim({sql} || ' ' || {where_sql} || ' ' || {order_sql})"
    elif csn == 5:
        join_sql = (
            "coalesce('JOIN ' || jt.name || ' ON ' || tbl.name || '.' || pair.main.name || ' = ' || jt.name "
            "|| '.' || pair.joined.name, '')"
        )
        join_en = "coalesce('join with ' || jt.name || ' on ' || pair.main.name || ' equals ' || pair.joined.name, '')"
        english = f"trim({english} || ' ' || {join_en} || ' ' || {where_en} || ' ' || {order_en})"
        sql = f"trim({sql} || ' ' || {join_sql} || ' ' || {where_sql} || ' ' || {order_sql})"
    extra = {
        "source_csn": str(csn),
        "command_set": str(2 if csn == 3 else csn),
        "agg_phrases": "list_filter(agg_all, lambda p: p IS NOT NULL)",
        "english_prompt": english,
        "sql_statement": sql,
        "where_texts": (
            "list_transform(conditions, lambda c: c.field.name || ' ' || c.operator || ' ' || c.literal)"
            if csn >= 4
            else "NULL::VARCHAR[]"
        ),
        "join_table": (
            "CASE WHEN pair IS NULL THEN NULL ELSE jt END"
            if csn == 5
            else "NULL::STRUCT(name VARCHAR, synonym VARCHAR, use_synonym BOOLEAN)"
        ),
    }
    if csn == 1:
        extra["order_by"] = "NULL::STRUCT(name VARCHAR, \"asc\" BOOLEAN)[]"
    s6 = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in extra.items()) + f" FROM {p}5"
    steps_sql = [s0, s1, s2, s3, s4, s5]
    ctes = [f"{p}{i} AS ({s})" for i, s in enumerate(steps_sql)]
    return ", ".join([*ctes, f"{name} AS ({s6})"])
