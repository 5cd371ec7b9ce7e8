"""The points scheme as DuckDB SQL."""

from __future__ import annotations

from promptloom.operators.score import KINDS, NOISE
from promptloom.plans.oracle.items import agg_text, alias_text, lit, words

BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def squish(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANKS}', ' ', 'g'))"


def steps(n: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {a} THEN {b}" for a, b in table) + " ELSE 0 END"


UNKNOWN = ((0, 10), (1, 8), (2, 6), (4, 4), (8, 2))
SURPLUS = ((2, 10), (4, 8), (6, 6), (8, 4), (10, 2))


def tokens(text: str) -> str:
    """Python-like split on blanks, commas stripped from each piece."""
    return (
        f"CASE WHEN trim({text}) = '' THEN []::VARCHAR[] ELSE list_transform("
        f"string_split(regexp_replace(trim({text}), ' +', ' ', 'g'), ' '), lambda t: trim(t, ',')) END"
    )


def prediction(kind: str) -> str:
    return {
        "exact": "sql_statement",
        "noise_after": f"sql_statement || {lit(' ' + NOISE)}",
        "noise_before": f"{lit(NOISE + ' ')} || sql_statement",
        "duplicate": "sql_statement || ' ' || sql_statement",
        "clause_dropped": "string_split(sql_statement, 'ORDER BY')[1]",
        "json_like": "'{\"sql\": \"' || sql_statement || '\", \"note\": \"done\"}'",
        "empty": "''",
    }[kind]


def score_ctes(csn: int, kinds=KINDS, source: str = "items", name: str = "scored") -> str:
    """CTEs ending in ``name``: item_id, kind, generated, earned, possible, score, exact."""
    p = name + "_"
    kind = "CASE item_id % {n} ".format(n=len(kinds)) + " ".join(
        f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)
    ) + " END"
    text = f"CASE item_id % {len(kinds)} " + " ".join(
        f"WHEN {i} THEN {prediction(k)}" for i, k in enumerate(kinds)
    ) + " END"
    c0 = f"SELECT *, {kind} AS kind, {text} AS generated FROM {source}"
    c1 = f"SELECT *, upper({squish('generated')}) AS norm FROM {p}0"
    head = "norm" if csn == 1 else "string_split(norm, 'ORDER BY')[1]"
    clause = (
        "''" if csn == 1 else
        "CASE WHEN len(string_split(norm, 'ORDER BY')) > 1 "
        "THEN 'ORDER BY ' || string_split(norm, 'ORDER BY')[2] ELSE '' END"
    )
    c2 = f"SELECT *, {head} AS head, {clause} AS clause FROM {p}1"
    field = f"upper({agg_text('f')})" if csn == 3 else "upper(f.name)"
    alias = (
        f"list_transform(list_filter(select_fields, lambda f: f.aggregate <> ''), "
        f"lambda f: upper({alias_text('f')}))" if csn == 3 else "[]::VARCHAR[]"
    )
    c3 = (
        f"SELECT *, {tokens('head')} AS tok, {tokens('clause')} AS otok, upper(tbl.name) AS tname, "
        f"list_transform(select_fields, lambda f: {field}) AS shown, {alias} AS aliases, "
        "coalesce(list_transform(order_by, lambda f: upper(f.name)), []::VARCHAR[]) AS onames "
        f"FROM {p}2"
    )
    c4 = (
        "SELECT *, coalesce(list_position(tok, 'SELECT'), 0) AS sp, coalesce(list_position(tok, 'FROM'), 0) AS fp, "
        f"coalesce(list_position(tok, tname), 0) AS tp FROM {p}3"
    )
    keys = ["SELECT", "AS", "FROM"] if csn == 3 else ["SELECT", "FROM"]
    known = f"list_concat(list_concat({words(keys)}, [tname]), list_concat(shown, aliases))"
    unknown = f"len(list_filter(tok, lambda t: NOT list_contains({known}, t)))"
    # Positions by brute force, the way the checks are worded.
    last_field = (
        "coalesce(list_max(list_transform(tok, lambda t, i: CASE WHEN list_contains(shown, t) THEN i ELSE 0 END)), 0)"
    )
    placed = (
        "len(list_filter(shown, lambda f: len(list_filter(list_transform(tok, lambda t, i: "
        "CASE WHEN t = f THEN i ELSE 1000000 END), lambda i: i <= sp)) = 0))"
    )
    earned = (
        "(sp > 0)::INT + (tp > 0)::INT + (fp > 0)::INT + (len(tok) > 0 AND tok[1] = 'SELECT')::INT"
        f" + {steps('length(head) - length(sql_statement)', SURPLUS)}"
        " + len(list_filter(shown, lambda f: list_contains(tok, f)))"
        " + len(list_filter(aliases, lambda f: list_contains(tok, f)))"
        f" + CASE WHEN sp > 0 THEN {placed} ELSE 0 END"
        f" + (fp > 0 AND fp > {last_field})::INT + (fp > 0 AND tp > fp)::INT + {steps(unknown, UNKNOWN)}"
    )
    possible = (
        "24 + len(shown) + len(aliases) + CASE WHEN sp > 0 THEN len(shown) ELSE 0 END + (fp > 0)::INT "
        "+ (fp > 0 AND tp > 0)::INT"
    )
    ounknown = "len(list_filter(otok, lambda t: NOT list_contains(list_concat(['ORDER','BY','ASC','DESC'], onames), t)))"
    oearned = (
        "CASE WHEN clause = '' THEN 0 ELSE (otok[1] = 'ORDER' AND otok[2] = 'BY')::INT"
        f" + len(list_filter(onames, lambda f: list_contains(otok, f))) + {steps(ounknown, UNKNOWN)} END"
    )
    opossible = "CASE WHEN clause = '' THEN 0 ELSE 11 + len(onames) END"
    if csn > 3:
        earned = possible = oearned = opossible = "0"
    c5 = (
        f"SELECT *, CASE WHEN norm = '' THEN 0 ELSE {earned} + {oearned} END AS earned, "
        f"CASE WHEN norm = '' THEN 0 ELSE {possible} + {opossible} END AS possible FROM {p}4"
    )
    n_order = "len(string_split(norm, 'ORDER BY')) - 1"
    order_ok = f"CASE WHEN len(onames) > 0 THEN {n_order} = 1 ELSE {n_order} = 0 END"
    checks = (
        "regexp_matches(norm, '\\b' || tname || '\\b')::INT + "
        "len(list_filter(select_fields, lambda f: regexp_matches(norm, '\\b' || upper(f.name) || '\\b')))"
        " + len(list_filter(coalesce(where_texts, []), lambda c: contains(norm, upper(c))))"
        " + coalesce(regexp_matches(norm, '\\bJOIN ' || upper(join_table.name) || '\\b'), false)::INT"
        f" + ({order_ok})::INT"
    )
    of = "2 + len(select_fields) + len(coalesce(where_texts, [])) + (join_table IS NOT NULL)::INT"
    strict = (
        f"CASE WHEN norm = '' THEN 0.0 WHEN source_csn <= 3 THEN (earned + CASE WHEN {order_ok} THEN 10 ELSE 0 END)"
        f"::DOUBLE / (possible + 10) ELSE ({checks})::DOUBLE / ({of}) END"
    )
    c6 = (
        "SELECT *, CASE WHEN possible = 0 THEN 0.0 ELSE earned::DOUBLE / possible END AS score, "
        f"{strict} AS strict_score, (generated = sql_statement)::INT AS exact FROM {p}5"
    )
    parts = [c0, c1, c2, c3, c4, c5]
    return ", ".join([*[f"{p}{i} AS ({c})" for i, c in enumerate(parts)], f"{name} AS ({c6})"])
