"""Base items and corruption features as DuckDB SQL."""

from __future__ import annotations

from promptloom.functions.draws import strides
from promptloom.operators.corrupt import CREATE_WORDS, FEATURES, promise_of
from promptloom.plans.oracle import items as O
from promptloom.sources.vocabulary import AGGREGATES, DEFAULT, PAIRS

IDS = "SELECT o_orderkey AS item_id FROM orders"


def base_ctes(
    name: str, *, ids: str = IDS, seed: int = 7, num_fields: int = 2, use_order_by=False,
    use_where=False, use_aggregates=False, syn_field=False, syn_table=False, vocab=DEFAULT,
) -> str:
    key, p, n = "item_id", name + "_", num_fields
    tables, fields = list(PAIRS.tables.items()), list(PAIRS.fields.items())
    place = O.draw_below(len(tables), seed, key, "b_table")
    steps = strides(len(fields))
    step = f"([{','.join(map(str, steps))}])[{O.draw_below(len(steps), seed, key, 'b_field_stride')} + 1]"
    at = f"(({O.draw_below(len(fields), seed, key, 'b_field_start')} + k * {step}) % {len(fields)})"
    block = O.digits(seed, key, "b_field", n)
    flag = str(syn_field).lower()
    s0 = (
        f"SELECT item_id, {{'name': ({O.words([t[0] for t in tables])})[{place} + 1], "
        f"'synonym': ({O.words([t[1] for t in tables])})[{place} + 1], 'use_synonym': {str(syn_table).lower()}}} AS tbl, "
        f"list_transform(range({n}), lambda k: {{'name': ({O.words([f[0] for f in fields])})[{at} + 1], "
        f"'type': {O.word_at(PAIRS.types, O.number_at(block, 'k'))}, "
        f"'synonym': ({O.words([f[1] for f in fields])})[{at} + 1], 'use_synonym': {flag}}}) AS table_fields "
        f"FROM ({ids})"
    )
    cols = {"wval_block": O.digits(seed, key, "wval", 4)}
    if use_where:
        cols["whr_rows"] = O.sample("table_fields", "1", O.digits(seed, key, "wsel", n))
    if use_aggregates:
        sel_number = O.number_at("agg_block", "k - 1")
        cols |= {
            "agg_block": O.digits(seed, key, "agg", n),
            "aphr_block": O.digits(seed, key, "aphr", n),
            "ophr_block": O.digits(seed, key, "ophr", n),
            "sel_rows": O.sample(
                "table_fields", f"1 + {O.draw_below('len(table_fields)', seed, key, 'nsel')}",
                O.digits(seed, key, "sel", n),
            ),
        }
    s1 = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in cols.items()) + f" FROM {p}0"
    cols = {"create_statement": O.create_text("tbl", "table_fields")}
    if use_where:
        kind, op = O.base_type("f.type"), O.number_at("wval_block", "3")
        cols["conditions"] = (
            "list_transform(whr_rows, lambda f, k: {'field': f, 'operator': CASE "
            f"WHEN {O.type_in(kind, O.N.NUMERIC_TYPES + O.N.DATE_TYPES)} THEN {O.word_at(O.N.RANGE_OPERATORS, op)} "
            f"WHEN {O.type_in(kind, O.N.TEXT_TYPES)} THEN 'LIKE' ELSE '=' END, "
            f"'literal': {O.literal_of(kind, 'wval_block', '(k - 1)')}}})"
        )
    if use_aggregates:
        drawn = O.rest(sel_number, 1)
        aggregate = (
            f"CASE WHEN {O.type_in('f.type', O.N.NUMERIC_TYPES)} THEN {O.word_at(O.N.NUMERIC_AGGREGATES, drawn)} "
            f"WHEN {O.type_in('f.type', O.N.TEXT_TYPES + O.N.DATE_TYPES)} THEN {O.word_at(O.N.ORDERED_AGGREGATES, drawn)} "
            f"ELSE {O.word_at(O.N.DEFAULT_AGGREGATES, drawn)} END"
        )
        use = f"{sel_number} % 2 = 0" if syn_field else "false"
        cols["sel"] = (
            f"list_transform(sel_rows, lambda f, k: {{'name': f.name, 'aggregate': {aggregate}, "
            f"'synonym': f.synonym, 'use_synonym': {use}}})"
        )
    else:
        cols["sel"] = (
            "list_transform(table_fields, lambda f: {'name': f.name, 'aggregate': '', "
            "'synonym': f.synonym, 'use_synonym': f.use_synonym})"
        )
    s2 = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in cols.items()) + f" FROM {p}1"
    where_en = where_sql = "''"
    if use_where:
        said = " ".join(f"WHEN '{op}' THEN '{text}'" for op, text in O.N.OPERATOR_WORDS.items())
        c = "conditions[1]"
        where_en = f"' where ' || {c}.field.name || ' is ' || CASE {c}.operator {said} END || ' ' || {c}.literal"
        where_sql = f"' WHERE ' || {c}.field.name || ' ' || {c}.operator || ' ' || {c}.literal"
    sql = (
        "'SELECT ' || array_to_string(list_transform(sel, lambda f: CASE WHEN f.aggregate = '' THEN f.name "
        f"ELSE {O.agg_text('f')} || ' AS ' || {O.alias_text('f')} END), ', ') || ' FROM ' || tbl.name || {where_sql}"
    )
    order_text = (
        "CASE WHEN len(order_by) = 0 THEN '' ELSE 'ORDER BY ' || array_to_string(list_transform(order_by, "
        "lambda f: f.name || CASE WHEN f.asc THEN ' ASC' ELSE ' DESC' END), ', ') END"
    )
    if use_aggregates:
        rows = O.sample(
            "sel", f"1 + {O.draw_below('len(sel)', seed, key, 'nord')}", O.digits(seed, key, "osel", n)
        )
        order = (
            f"list_transform({rows}, lambda f: {{'name': f.name, 'asc': {O.draw_below(2, seed, key, 'odir')} = 1}})"
            if use_order_by else "[]::STRUCT(name VARCHAR, \"asc\" BOOLEAN)[]"
        )
        phrase = "CASE " + " ".join(
            f"WHEN f.aggregate = '{a}' THEN {O.word_at(vocab.agg_phrases[a], O.number_at('aphr_block', 'k - 1'))}"
            for a in AGGREGATES
        ) + " END"
        on = O.number_at("ophr_block", "k - 1")
        s3 = (
            f"SELECT *, list_transform(sel, lambda f, k: {phrase}) AS agg_all, {order} AS order_by FROM {p}2"
        )
        s4 = (
            "SELECT *, list_transform(order_by, lambda f, k: CASE WHEN f.asc THEN "
            f"{O.word_at(vocab.asc_phrases(), on)} ELSE {O.word_at(vocab.desc_phrases(), on)} END) AS order_by_phrase, "
            "list_filter(agg_all, lambda p: p IS NOT NULL) AS agg_phrases, list_transform(sel, lambda f, k: "
            f"CASE WHEN agg_all[k] IS NULL THEN '' ELSE agg_all[k] || ' ' END || {O.shown('f')}) AS spoken FROM {p}3"
        )
        said = (
            "CASE WHEN len(spoken) > 1 THEN array_to_string(list_slice(spoken, 1, len(spoken) - 1), ', ') "
            "|| ' and ' ELSE '' END || spoken[len(spoken)]"
        )
        english = (
            f"replace(replace({O.pick_word(vocab.select_templates, seed, key, 'tpl')}, '[fields]', {said}), "
            f"'[table]', {O.shown('tbl')}) || {where_en} || ' ' || coalesce(array_to_string(list_transform(order_by, "
            "lambda f, k: ' ' || order_by_phrase[k] || ' ' || f.name), ','), '')"
        )
        sql = f"{sql} || ' ' || {order_text}"
    else:
        chosen = f"table_fields[{O.draw_below('len(table_fields)', seed, key, 'b_order')} + 1]"
        order = (
            f"[{{'name': {chosen}.name, 'asc': {O.draw_below(2, seed, key, 'b_dir')} = 1}}]"
            if use_order_by else "[]::STRUCT(name VARCHAR, \"asc\" BOOLEAN)[]"
        )
        s3 = f"SELECT *, {order} AS order_by, list_transform(table_fields, lambda f: {O.shown('f')}) AS said FROM {p}2"
        direction = "CASE WHEN order_by[1].asc THEN 'ascending' ELSE 'descending' END"
        phrases = f"[{direction}]" if use_order_by else "[]::VARCHAR[]"
        s4 = f"SELECT *, {phrases} AS order_by_phrase, []::VARCHAR[] AS agg_phrases FROM {p}3"
        ordered = (
            f"' ordered by ' || {O.shown(chosen)} || ' in ' || {direction} || ' order'" if use_order_by else "''"
        )
        english = (
            f"'show me the ' || array_to_string(list_slice(said, 1, {n - 1}), ', ') || ' and ' || said[{n}] || "
            f"' from the ' || {O.shown('tbl')} || ' table' || {where_en} || {ordered}"
        )
        if use_order_by:
            sql = f"{sql} || ' ' || {order_text}"
    extra = {"english_prompt": english, "sql_statement": sql}
    s5 = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in extra.items()) + f" FROM {p}4"
    steps_sql = [s0, s1, s2, s3, s4]
    return ", ".join([*[f"{p}{i} AS ({s})" for i, s in enumerate(steps_sql)], f"{name} AS ({s5})"])


def first(text: str, old: str, new: str) -> str:
    return (
        f"CASE WHEN {old} IS NULL OR strpos({text}, {old}) = 0 THEN {text} ELSE substr({text}, 1, strpos({text}, {old}) - 1) "
        f"|| {new} || substr({text}, strpos({text}, {old}) + length({old})) END"
    )


def first_after(text: str, mark: str, old: str, new: str) -> str:
    m = len(mark)
    tail = f"substr({text}, strpos({text}, '{mark}') + {m})"
    return (
        f"CASE WHEN strpos({text}, '{mark}') = 0 THEN {text} ELSE substr({text}, 1, strpos({text}, '{mark}') + {m} - 1) "
        f"|| {first(tail, old, new)} END"
    )


def end(text: str, old: str, new: str) -> str:
    return f"substr({text}, 1, length({text}) - length({old})) || {new}"


def other(pool, used: str, slot: str, seed: int = 7) -> str:
    left = f"list_filter({O.words(pool)}, lambda w: NOT list_contains({used}, w))"
    return f"({left})[{O.draw_below(f'greatest(len({left}), 1)', seed, 'item_id', slot)} + 1]"


def feature_sql(feature: str, base: str, novel: bool = False, seed: int = 7) -> str:
    """SELECT over the feature's base items: tokens and corrupt texts, changed or not."""
    tables = list(PAIRS.novel_tables if novel else PAIRS.tables)
    fields = list(PAIRS.novel_fields if novel else PAIRS.fields)
    shown_table, f1 = O.shown("tbl"), "table_fields[1]"
    names = "list_transform(table_fields, lambda f: f.name)"
    shown_names = f"list_transform(table_fields, lambda f: {O.shown('f')})"
    e, c, s = "english_prompt", "create_statement", "sql_statement"
    en = cr = sq = jn = "NULL::VARCHAR"
    answer = "clean"
    if feature == "EngTableName":
        clean, wrong, answer = shown_table, other(tables, f"[{shown_table}]", "c_table"), "tbl.name"
        en = f"replace({e}, clean, wrong)"
    elif feature == "EngFieldName":
        clean, wrong, answer = O.shown(f1), other(fields, shown_names, "c_field"), f"{f1}.name"
        en = f"replace({e}, clean, wrong)"
    elif feature == "DefCreateTable":
        clean, wrong, answer = "'CREATE'", O.pick_word(CREATE_WORDS, seed, "item_id", "c_create"), "wrong"
        cr = f"replace({c}, clean, wrong)"
    elif feature == "DefTableName":
        clean, wrong = "tbl.name", other(tables, "[tbl.name]", "c_table")
        cr = f"replace({c}, clean, wrong)"
    elif feature == "DefFieldName":
        clean, wrong = f"{f1}.name", other(fields, names, "c_field")
        cr = f"replace({c}, clean, wrong)"
    elif feature == "DefFieldSeparator":
        clean, wrong = "','", "':'"
        cr = f"replace({c}, clean, wrong)"
    elif feature.startswith("DefOrderByField"):
        at = "1" if feature.endswith("1") else "least(2, len(order_by))"
        clean = f"order_by[{at}].name"
        wrong = other(fields, f"[{clean}]", "c_field")
        said = (
            f"CASE WHEN contains({e}, clean) THEN clean ELSE list_filter(table_fields, lambda f: f.name = clean)[1].synonym END"
        )
        en, sq = f"replace({e}, {said}, wrong)", first_after(s, "ORDER BY", "clean", "wrong")
    elif feature.startswith("DefOrderByDirection"):
        second = feature.endswith("2")
        at = "least(2, len(order_by))" if second else "1"
        clean = f"CASE WHEN order_by[{at}].asc THEN 'ASC' ELSE 'DESC' END"
        wrong = f"CASE WHEN order_by[{at}].asc THEN 'DESC' ELSE 'ASC' END"
        parts = (
            "array_to_string(list_transform(order_by, lambda f, k: f.name || CASE WHEN f.asc {} THEN ' ASC' ELSE ' DESC' END), ', ')"
        )
        sq = end(s, parts.format(""), parts.format(f"<> (k = {at})"))
        if second:
            said = "array_to_string(list_transform(order_by, lambda f, k: ' ' || {} || ' ' || f.name), ',')"
            drawn = (
                f"CASE WHEN clean = 'ASC' THEN {O.pick_word(DEFAULT.desc_phrases(), seed, 'item_id', 'c_phrase')} "
                f"ELSE {O.pick_word(DEFAULT.asc_phrases(), seed, 'item_id', 'c_phrase')} END"
            )
            one = f"CASE WHEN k = {at} THEN {drawn} ELSE order_by_phrase[k] END"
            en = end(e, said.format("order_by_phrase[k]"), said.format(one))
        else:
            words = "CASE {} WHEN 'ASC' THEN 'ascending' ELSE 'descending' END || ' order'"
            en = end(e, words.format("clean"), words.format("wrong"))
    elif feature.startswith("DefAggregate"):
        called = "list_filter(range(1, len(sel) + 1), lambda k: sel[k].aggregate <> '')"
        at = f"({called})[" + ("1" if feature.endswith("1") else f"least(2, len({called}))") + "]"
        agg, field = f"sel[{at}].aggregate", f"sel[{at}].name"
        if "Function" in feature:
            clean, wrong = agg, other(AGGREGATES, f"[{agg}]", "c_agg")
            n = O.draw(seed, "item_id", "c_aphr")
            phrase = "CASE wrong " + " ".join(
                f"WHEN '{a}' THEN {O.word_at(DEFAULT.agg_phrases[a], n)}" for a in AGGREGATES
            ) + " END"
            sq = f"replace({s}, clean || '(' || {field} || ')', wrong || '(' || {field} || ')')"
            # The whole prompt again, with another phrase for this field.
            swapped = (
                f"list_transform(spoken, lambda x, k: CASE WHEN k = {at} THEN {phrase} || ' ' || {O.shown('sel[k]')} ELSE x END)"
            )
            ordered = (
                "coalesce(array_to_string(list_transform(order_by, lambda f, k: ' ' || order_by_phrase[k] || ' ' || f.name), ','), '')"
            )
            en = (
                f"(SELECT replace(replace({O.pick_word(DEFAULT.select_templates, seed, 'item_id', 'tpl')}, '[fields]', "
                f"CASE WHEN len(sp) > 1 THEN array_to_string(list_slice(sp, 1, len(sp) - 1), ', ') || ' and ' ELSE '' END "
                f"|| sp[len(sp)]), '[table]', {shown_table}) || ' ' || {ordered} FROM (SELECT {swapped} AS sp))"
            )
        else:
            clean, wrong = field, other(fields, f"[{field}]", "c_field")
            said = (
                f"CASE WHEN contains({e}, clean) THEN clean ELSE "
                "list_filter(table_fields, lambda f: f.name = clean)[1].synonym END"
            )
            sq = f"replace({s}, {agg} || '(' || clean || ')', {agg} || '(' || wrong || ')')"
            en = f"replace({e}, {said}, wrong)"
    elif feature == "DefWhereField1":
        clean = "conditions[1].field.name"
        left = f"list_filter({names}, lambda w: w <> {clean})"
        wrong = f"({left})[{O.draw_below(f'greatest(len({left}), 1)', seed, 'item_id', 'c_where')} + 1]"
        sq = first_after(s, "WHERE", "clean", "wrong")
    elif feature == "DefWhereLiteral1":
        clean = "conditions[1].literal"
        kind = O.base_type("conditions[1].field.type")
        wrong = O.literal_of(kind, O.digits(seed, "item_id", "c_literal", 4), "0")
        sq = first_after(s, "WHERE", "clean", "wrong")
    else:
        clean = "join_table.name"
        wrong = other([t[0] for t in DEFAULT.tables], f"[{clean}]", "c_join")
        once = first(s, "'JOIN ' || clean || ' ON '", "'JOIN ' || wrong || ' ON '")
        owner = first("q", "' = ' || clean || '.'", "' = ' || wrong || '.'")
        sq = f"(SELECT {owner} FROM (SELECT {once} AS q))"
        jn = "wrong"
    return (
        f"SELECT '{feature}' AS feature_name, item_id, clean AS clean_token, wrong AS corrupt_token, {answer} AS answer_token, "
        f"{e}, {c}, {s}, {en} AS corrupt_english_prompt, {cr} AS corrupt_create_statement, {sq} AS corrupt_sql_statement, "
        f"{jn} AS corrupt_join_table FROM (SELECT *, {wrong} AS wrong FROM (SELECT *, {clean} AS clean FROM {base}))"
    )


CORRUPT_OF = {
    "changed_ddl": "coalesce(corrupt_create_statement <> create_statement, false)",
    "changed_prompt": "coalesce(corrupt_english_prompt <> english_prompt, false)",
    "changed_sql": "coalesce(corrupt_sql_statement <> sql_statement, false)",
}


def candidates_ctes(features=tuple(FEATURES), name: str = "cand", novel: bool = False, **options) -> str:
    """One relation with all candidates of the features and whether the promise is kept."""
    ctes, selects, made = [], [], {}
    for feature in features:
        opts = FEATURES[feature][1]
        base = "b_" + "_".join(sorted(opts)) if opts else "b_plain"
        if base not in made:
            made[base] = True
            if opts.get("use_join"):
                named = {k: options[k] for k in ("syn_table", "syn_field") if k in options}
                ctes.append(O.items_ctes(5, name=base, **named))
            else:
                ctes.append(base_ctes(base, **opts, **options))
        rows = f"c_{feature}"
        ctes.append(f"{rows} AS ({feature_sql(feature, base, novel)})")
        selects.append(f"SELECT *, {CORRUPT_OF[promise_of(feature)]} AS kept FROM {rows}")
    return ", ".join([*ctes, f"{name} AS ({' UNION ALL '.join(selects)})"])

