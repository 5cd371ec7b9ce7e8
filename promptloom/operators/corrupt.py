"""Clean/corrupt pairs: base items of a fixed sentence shape, and one edit per feature.

Every feature is a projection over its base items; a row the feature cannot change is
left out and counted by :func:`feature_counts`, never drawn again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from promptloom.functions import names as N, text as T, tokens as K
from promptloom.functions.draws import (
    digest, draw, draw_below, each, elements, held, let, numbers, pick, pick_short, sample_start, text_array, with_computed,
)
from promptloom.operators import generate as G
from promptloom.sources import schemas as S
from promptloom.sources.vocabulary import AGGREGATES, DEFAULT, PAIRS, PairVocabulary, Vocabulary

# Words that take the place of CREATE, and of the comma in a table definition.
CREATE_WORDS = ("MAKE", "BUILD", "GENERATE", "CONSTRUCT")
SEPARATORS = (":",)

BASE_COLUMNS = (
    "item_id", "command_set", "table_name", "table_fields", "create_statement", "select",
    "order_by", "order_by_phrase", "agg_phrases", "english_prompt", "sql_statement",
    "where_fields", "where_literals", "where", "join_table",
)


def make_base_items(
    ids: DataFrame,
    seed: int = 7,
    *,
    id_col: str = "item_id",
    num_fields: int = 2,
    use_order_by: bool = False,
    use_where: bool = False,
    use_aggregates: bool = False,
    use_synonyms_field: bool = False,
    use_synonyms_table: bool = False,
    words: PairVocabulary = PAIRS,
    vocab: Vocabulary = DEFAULT,
) -> DataFrame:
    """Base items: ``show me the a and b from the t table [where ..] [ordered by ..]``.

    With aggregates, the SELECT list, its English and ORDER BY come from the item
    generators, over the same small table.
    """
    key, fields = "item_id", F.col("table_fields")
    start, step = sample_start(len(words.fields), seed, key, "b_field")
    draws = {
        "_start": start,
        "_step": step,
        "_field": numbers(seed, key, "b_field", num_fields),
        "_tab": draw(seed, key, "b_table"),
        **G.clause_draws(key, seed, num_fields, use_order_by, use_where),
    }
    named = {
        "tables": [{"name": n, "synonym": s} for n, s in words.tables.items()],
        "fields": [{"name": n, "synonym": s} for n, s in words.fields.items()],
        "types": words.types,
    }
    table = G.lookup("pair_tables", "_tab")
    found = {"_tname": F.expr(f"{table}.name"), "_tsynonym": F.expr(f"{table}.synonym")}
    rows = []
    for k in range(num_fields):
        row = G.lookup("pair_fields", f"(_start + {k} * _step)")
        kind = G.lookup("pair_types", f"_field[{k}]")
        rows.append(
            f"named_struct('name', {row}.name, 'type', {kind}, 'synonym', {row}.synonym, "
            f"'use_synonym', {str(use_synonyms_field).lower()})"
        )
    found["table_fields"] = F.expr(f"array({', '.join(rows)})")
    drawn = ids.select(F.col(id_col).alias("item_id")).withColumns({f"_v_pair_{n}": held(v) for n, v in named.items()})
    if use_aggregates:
        drawn = G.with_vocabulary(drawn, vocab)
        draws |= {"_ntpl": draw(seed, key, "tpl"), "_ncphr": draw(seed, key, "c_phrase"), "_ncagg": draw(seed, key, "c_aphr")}
        found |= {"_template": F.expr(G.lookup("templates", "_ntpl")), **G.phrase_lookups(num_fields, use_order_by)}
        # what takes the place of a phrase: one of either direction, one of each aggregate
        found |= {f"_c_{d}": F.expr(G.lookup(d, "_ncphr")) for d in ("asc", "desc")}
        found |= {f"_c_{a}": F.expr(G.lookup(a, "_ncagg")) for a in AGGREGATES}
    items = G.without_vocabulary(with_computed(drawn.withColumns(draws), found))
    shown = F.lit(use_synonyms_table).alias("use_synonym")
    items = items.withColumn("table_name", F.struct(F.col("_tname").alias("name"), F.col("_tsynonym").alias("synonym"), shown))
    no_order = G.empty_array(S.ORDER)
    condition = f"struct<field:{S.FIELD},operator:string,literal:string>"
    conditions = (
        G.draw_conditions(fields, max_conditions=1)
        if use_where
        else G.empty_array(condition)
    )
    clauses = {"_conditions": conditions}
    if use_aggregates:
        clauses["select"] = G.draw_select(fields, True, use_synonyms_field, bound=num_fields)
    else:
        clauses["select"] = each(
            fields,
            num_fields,
            lambda f, k: F.struct(
                f["name"].alias("name"), F.lit("").alias("aggregate"), f["synonym"], f["use_synonym"]
            ),
        )
        asc = draw_below(2, seed, key, "b_dir") == 1
        one = F.struct(pick(fields, seed, key, "b_order")["name"].alias("name"), asc.alias("asc"))
        clauses["order_by"] = F.array(one) if use_order_by else no_order
    items = items.withColumns(clauses)
    select, order = F.col("select"), F.col("order_by")
    spoken_where = G.english_where(F.col("_conditions"))
    spaced_where = F.when(spoken_where == "", F.lit("")).otherwise(
        F.concat(F.lit(" "), spoken_where)
    )
    written_where = G.where_sql(F.col("_conditions"))
    sql_where = F.when(written_where == "", F.lit("")).otherwise(
        F.concat(F.lit(" "), written_where)
    )
    table = F.col("table_name")
    if use_aggregates:
        items = items.withColumns(
            {
                "_agg_all": G.draw_agg_phrases(select, num_fields),
                "order_by": G.draw_order(select, num_fields) if use_order_by else no_order,
            }
        ).withColumns(
            {
                "order_by_phrase": (
                    G.draw_order_phrases(order, num_fields)
                    if use_order_by
                    else F.array().cast("array<string>")
                ),
                "agg_phrases": F.filter(F.col("_agg_all"), lambda p: p.isNotNull()),
            }
        )
        said = G.english_select(F.col("_template"), table, select, F.col("_agg_all"), num_fields)
        spoken_order = G.english_order(order, F.col("order_by_phrase"), num_fields)
        english = F.concat(said, spaced_where, F.lit(" "), spoken_order)
        sql = F.concat(G.select_sql(table, select, num_fields), sql_where, F.lit(" "), G.order_sql(order, num_fields))
    else:
        shown = each(fields, num_fields, lambda f, k: N.display_name(f))
        listed = F.concat(
            F.array_join(F.slice(shown, F.lit(1), F.lit(num_fields - 1)), ", "),
            F.lit(" and "),
            F.element_at(shown, -1),
        )
        first = F.get(order, F.lit(0))
        direction = F.when(first["asc"], F.lit("ascending")).otherwise(F.lit("descending"))
        ordered = F.coalesce(*[F.when(f["name"] == first["name"], N.display_name(f)) for f in elements(fields, num_fields)])
        spoken_order = F.concat(
            F.lit(" ordered by "), ordered, F.lit(" in "),
            direction, F.lit(" order"),
        )
        items = items.withColumns(
            {
                "order_by_phrase": F.array(direction) if use_order_by else F.array().cast("array<string>"),
                "agg_phrases": F.array().cast("array<string>"),
            }
        )
        english = F.concat(
            F.lit("show me the "), listed, F.lit(" from the "), N.display_name(table),
            F.lit(" table"), spaced_where, spoken_order if use_order_by else F.lit(""),
        )
        sql = F.concat(G.select_sql(table, select, num_fields), sql_where)
        if use_order_by:
            sql = F.concat(sql, F.lit(" "), G.order_sql(order, 1))
    ready = with_computed(items, {"english_prompt": english, "sql_statement": sql})
    return ready.withColumns(
        {
            "command_set": F.lit(2 if use_order_by or use_aggregates else 1),
            "create_statement": G.create_statement(table, fields, num_fields),
            "where_fields": F.col("_conditions")["field"],
            "where_literals": F.col("_conditions")["literal"],
            "where": F.transform(F.col("_conditions"), G.condition_text),
            "join_table": F.lit(None).cast(S.TABLE),
        }
    ).select(*BASE_COLUMNS, *[c for c in ready.columns if c.startswith("_c_")])


# ------------------------------------------------------------------------ the features
def other_word(pool: list[str] | tuple, used: Column, seed: int, key: Column | str, slot: str) -> Column:
    """A word of a short pool that is not among the used ones."""
    return pick(F.array_except(text_array(pool), used), seed, key, slot)


def other_entry(items: DataFrame, column: str, pool: list[str], used: Column, seed: int, slot: str) -> DataFrame:
    """Adds a word of a vocabulary of any length that is not the used one."""
    words = list(dict.fromkeys(pool))
    place = F.coalesce(F.array_position("_pool", used), F.lit(0))  # from 1; 0 if it is not there
    drawn = items.withColumns({"_pool": held(words), "_number": draw(seed, "item_id", slot)}).withColumn("_place", place)
    at = F.expr(f"cast(_number % greatest({len(words)} - if(_place > 0, 1, 0), 1) as int)")
    drawn = drawn.withColumn("_at", at)
    behind = F.expr("get(_pool, _at + if(_place > 0 AND _at >= _place - 1, 1, 0))")
    return with_computed(drawn, {column: behind}).drop("_pool", "_number", "_place", "_at")


def edit(clean: Column, corrupt: Column, answer: Column | None = None, **texts: Column) -> dict:
    return {"clean": clean, "corrupt": corrupt, "answer": clean if answer is None else answer, **texts}


def replace_end(text: Column, old: Column, new: Column) -> Column:
    """The text with its known end exchanged."""
    return F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(old)), new)


class Features:
    """The edits by feature name, for one seed and vocabulary."""

    def __init__(self, seed: int, words: PairVocabulary, vocab: Vocabulary, novel: bool):
        self.seed, self.words, self.vocab = seed, words, vocab
        self.table_pool = list(words.novel_tables if novel else words.tables)
        self.field_pool = list(words.novel_fields if novel else words.fields)
        self.key = "item_id"

    def table_word(self, used: Column) -> Column:
        return other_word(self.table_pool, F.array(used), self.seed, self.key, "c_table")

    def field_word(self, used: Column) -> Column:
        return other_word(self.field_pool, used, self.seed, self.key, "c_field")

    # -- prompt
    def eng_table_name(self) -> dict:
        shown = N.display_name(F.col("table_name"))
        wrong = self.table_word(shown)
        return edit(shown, wrong, F.col("table_name.name"),
                    english=F.replace("english_prompt", shown, wrong))

    def eng_field_name(self) -> dict:
        first = F.get("table_fields", F.lit(0))
        shown = N.display_name(first)
        wrong = self.field_word(F.transform("table_fields", N.display_name))
        return edit(shown, wrong, first["name"],
                    english=F.replace("english_prompt", shown, wrong))

    # -- table definition
    def def_create_table(self) -> dict:
        wrong = pick_short(CREATE_WORDS, self.seed, self.key, "c_create")
        clean = F.lit("CREATE")
        return edit(clean, wrong, wrong, create=F.replace("create_statement", clean, wrong))

    def def_table_name(self) -> dict:
        clean = F.col("table_name.name")
        wrong = self.table_word(clean)
        return edit(clean, wrong, create=F.replace("create_statement", clean, wrong))

    def def_field_name(self) -> dict:
        clean = F.get("table_fields", F.lit(0))["name"]
        wrong = self.field_word(F.col("table_fields")["name"])
        return edit(clean, wrong, create=F.replace("create_statement", clean, wrong))

    def def_field_separator(self) -> dict:
        clean, wrong = F.lit(","), pick_short(SEPARATORS, self.seed, self.key, "c_sep")
        return edit(clean, wrong, create=F.replace("create_statement", clean, wrong))

    # -- ORDER BY
    def order_field(self, place: int) -> dict:
        order = F.col("order_by")
        chosen = F.get(order, F.least(F.lit(place), F.size(order) - 1))["name"]
        wrong = self.field_word(F.array(chosen))
        # The prompt names the field by its name, or by its synonym.
        named = F.filter("table_fields", lambda f: f["name"] == chosen)
        synonym = F.get(named, F.lit(0))["synonym"]
        said = F.when(F.contains("english_prompt", chosen), chosen).otherwise(synonym)
        return edit(
            chosen,
            wrong,
            english=F.replace("english_prompt", said, wrong),
            sql=T.replace_first_after(F.col("sql_statement"), "ORDER BY", chosen, wrong),
        )

    def order_direction(self, second: bool, phrases_spoken: bool) -> dict:
        """Turn one direction, in the SQL and in the prompt, each at its own place.

        Items with aggregates end with a phrase and a field for each part of the order;
        the others end with ``in <direction> order``.
        """
        order, phrases = F.col("order_by"), F.col("order_by_phrase")
        place = F.least(F.lit(1 if second else 0), F.size(order) - 1)
        asc = F.get(order, place)["asc"]
        clean = F.when(asc, F.lit("ASC")).otherwise(F.lit("DESC"))
        wrong = F.when(asc, F.lit("DESC")).otherwise(F.lit("ASC"))
        turned = F.transform(
            order,
            lambda f, i: F.struct(
                f["name"].alias("name"), F.when(i == place, ~f["asc"]).otherwise(f["asc"]).alias("asc")
            ),
        )
        sql = replace_end(F.col("sql_statement"), G.order_sql(order), G.order_sql(turned))
        english = F.col("english_prompt")
        if phrases_spoken:
            other = F.when(asc, F.col("_c_desc")).otherwise(F.col("_c_asc"))
            said = F.transform(phrases, lambda p, i: F.when(i == place, other).otherwise(p))
            english = replace_end(english, G.english_order(order, phrases), G.english_order(order, said))
        else:
            words = {"ASC": "ascending order", "DESC": "descending order"}
            before, after = (
                F.when(c == "ASC", F.lit(words["ASC"])).otherwise(F.lit(words["DESC"])) for c in (clean, wrong)
            )
            english = replace_end(english, before, after)
        return edit(clean, wrong, sql=sql, english=english)

    # -- aggregates
    def _call(self, second: bool) -> tuple[Column, Column, Column]:
        """Aggregate, field and number of the first or second ``AGG(field)``."""
        called = F.filter("select", lambda f: f["aggregate"] != "")
        at = F.least(F.lit(1 if second else 0), F.size(called) - 1)
        return F.get(called, at)["aggregate"], F.get(called, at)["name"], at

    def aggregate_function(self, second: bool) -> dict:
        agg, field, at = self._call(second)
        wrong = other_word(AGGREGATES, F.array(agg), self.seed, self.key, "c_agg")
        phrase = let(
            wrong, lambda w: F.coalesce(*[F.when(w == a, F.col(f"_c_{a}")) for a in AGGREGATES])
        )

        def call(name: Column) -> Column:
            return F.concat(name, F.lit("("), field, F.lit(")"))

        # The phrases by field again, the one of this call exchanged.
        select, phrases = F.col("select"), F.col("agg_phrases")
        before = F.transform(
            select,
            lambda f, i: F.when(
                f["aggregate"] != "",
                F.size(F.filter(F.slice(select, F.lit(1), i), lambda g: g["aggregate"] != "")),
            ),
        )
        said = F.transform(before, lambda k: F.get(phrases, k))
        exchanged = F.transform(before, lambda k: F.when(k == at, phrase).otherwise(F.get(phrases, k)))
        return edit(
            agg,
            wrong,
            sql=F.replace("sql_statement", call(agg), call(wrong)),
            english=T.replace_first(
                F.col("english_prompt"),
                G.spoken_fields(select, said),
                G.spoken_fields(select, exchanged),
            ),
        )

    def aggregate_field(self, second: bool) -> dict:
        agg, field, _ = self._call(second)
        wrong = self.field_word(F.array(field))
        named = F.filter("table_fields", lambda f: f["name"] == field)
        synonym = F.get(named, F.lit(0))["synonym"]
        said = F.when(F.contains("english_prompt", field), field).otherwise(synonym)

        def call(name: Column) -> Column:
            return F.concat(agg, F.lit("("), name, F.lit(")"))

        return edit(
            field,
            wrong,
            sql=F.replace("sql_statement", call(field), call(wrong)),
            english=F.replace("english_prompt", said, wrong),
        )

    # -- WHERE and JOIN
    def where_field(self) -> dict:
        clean = F.get("where_fields", F.lit(0))["name"]
        others = F.array_except(F.col("table_fields")["name"], F.array(clean))
        wrong = pick(others, self.seed, self.key, "c_where")
        sql = T.replace_first_after(F.col("sql_statement"), "WHERE", clean, wrong)
        return edit(clean, wrong, sql=sql)

    def where_literal(self) -> dict:
        clean = F.get("where_literals", F.lit(0))
        kind = T.base_type(F.get("where_fields", F.lit(0))["type"])
        wrong = G.draw_literal(kind, digest(self.seed, self.key, "c_literal", "0"))
        sql = T.replace_first_after(F.col("sql_statement"), "WHERE", clean, wrong)
        return edit(clean, wrong, sql=sql)

    def join_table(self) -> dict:
        clean, wrong = F.col("join_table.name"), F.col("_c_join")
        sql = F.col("sql_statement")
        for before, after in (("JOIN ", " ON "), (" = ", ".")):
            sql = T.replace_first(
                sql,
                F.concat(F.lit(before), clean, F.lit(after)),
                F.concat(F.lit(before), wrong, F.lit(after)),
            )
        return edit(clean, wrong, sql=sql, join=wrong)


# Feature name → (edit, base-item options). The feature names.
FEATURES: dict[str, tuple[Callable[[Features], dict], dict]] = {
    "EngTableName": (Features.eng_table_name, {}),
    "EngFieldName": (Features.eng_field_name, {}),
    "DefCreateTable": (Features.def_create_table, {}),
    "DefTableName": (Features.def_table_name, {}),
    "DefFieldSeparator": (Features.def_field_separator, {}),
    "DefFieldName": (Features.def_field_name, {}),
    "DefOrderByField1": (lambda f: f.order_field(0), {"use_order_by": True}),
    "DefOrderByField2": (lambda f: f.order_field(1), {"use_order_by": True, "use_aggregates": True}),
    "DefOrderByDirection1": (lambda f: f.order_direction(False, False), {"use_order_by": True}),
    "DefOrderByDirection2": (
        lambda f: f.order_direction(True, True), {"use_order_by": True, "use_aggregates": True},
    ),
    "DefAggregateFunction1": (lambda f: f.aggregate_function(False), {"use_aggregates": True}),
    "DefAggregateFunction2": (lambda f: f.aggregate_function(True), {"use_aggregates": True}),
    "DefAggregateField1": (lambda f: f.aggregate_field(False), {"use_aggregates": True}),
    "DefAggregateField2": (lambda f: f.aggregate_field(True), {"use_aggregates": True}),
    "DefWhereField1": (Features.where_field, {"use_where": True}),
    "DefWhereLiteral1": (Features.where_literal, {"use_where": True}),
    "DefJoinTable1": (Features.join_table, {"use_join": True}),
}
SECOND_OCCURRENCE = ("DefTableName", "DefFieldName", "DefFieldSeparator")
# What a feature promises to change.
PROMISES = {"Eng": "changed_prompt", "Def": "changed_sql"}
DDL_FEATURES = ("DefCreateTable", "DefTableName", "DefFieldName", "DefFieldSeparator")


def promise_of(feature: str) -> str:
    if feature in DDL_FEATURES:
        return "changed_ddl"
    return PROMISES[feature[:3]]


def corrupt_candidates(
    ids: DataFrame,
    features=tuple(FEATURES),
    seed: int = 7,
    *,
    id_col: str = "item_id",
    use_novel_names: bool = False,
    use_synonyms_field: bool = False,
    use_synonyms_table: bool = False,
    num_fields: int = 2,
    words: PairVocabulary = PAIRS,
    vocab: Vocabulary = DEFAULT,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All base items of the features with their edits; ``kept`` tells whether the edit
    changed what its feature promises.

    Features that start from the same base items share them: the items are drawn once
    and give one row per feature in place. ``prepare`` may add columns to base items, such as
    their tokens, which are so made once whatever the number of features.
    """
    unknown = set(features) - set(FEATURES)
    if unknown:
        raise ValueError(f"unknown feature: {sorted(unknown)}")
    groups: dict[tuple, list[str]] = {}
    for feature in features:
        groups.setdefault(tuple(sorted(FEATURES[feature][1])), []).append(feature)
    edits = Features(seed, words, vocab, use_novel_names)
    synonyms = {"use_synonyms_table": use_synonyms_table, "use_synonyms_field": use_synonyms_field}
    parts = []
    for options, group in groups.items():
        if "use_join" in options:
            items = G.generate_items(ids, 5, seed, id_col=id_col, vocab=vocab, **synonyms)
            names = [t[0] for t in vocab.tables]
            base = other_entry(items.select(*BASE_COLUMNS), "_c_join", names, F.col("join_table.name"), seed, "c_join")
        else:
            base = make_base_items(
                ids, seed, id_col=id_col, num_fields=num_fields, words=words, vocab=vocab,
                **synonyms, **dict.fromkeys(options, True),
            )
        if prepare is not None:
            base = prepare(base)
        # A generator interprets what it holds, so the edits are columns before they become rows.
        rows = {f"_edit{k}": _edit_row(f, FEATURES[f][0](edits)) for k, f in enumerate(group)}
        edited = base.withColumns(rows).select(*base.columns, F.inline(F.array(*rows)))
        parts.append(edited.drop(*[c for c in base.columns if c.startswith("_c_")]))

    edited = with_changes(reduce(DataFrame.unionByName, parts))
    edited = edited.withColumn("use_novel_names", F.lit(use_novel_names))
    return edited.withColumn("kept", kept_promise())


def _edit_row(feature: str, parts: dict) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(feature).alias("feature_name"),
        parts["clean"].alias("clean_token"),
        parts["corrupt"].alias("corrupt_token"),
        parts["answer"].alias("answer_token"),
        parts.get("english", none).alias("corrupt_english_prompt"),
        parts.get("create", none).alias("corrupt_create_statement"),
        parts.get("sql", none).alias("corrupt_sql_statement"),
        parts.get("join", none).alias("corrupt_join_table"),
    )


def kept_promise() -> Column:
    """Did the pair change the text its feature promises to change?"""
    feature = F.col("feature_name")
    return (
        F.when(feature.isin(*DDL_FEATURES), F.col("changed_ddl"))
        .when(F.startswith(feature, F.lit("Eng")), F.col("changed_prompt"))
        .otherwise(F.col("changed_sql"))
    )


def corrupt_items(ids: DataFrame, features=tuple(FEATURES), seed: int = 7, **options) -> DataFrame:
    """Clean/corrupt pairs of the named features, in one table."""
    return corrupt_candidates(ids, features, seed, **options).where("kept").drop("kept")


def feature_counts(ids: DataFrame, features=tuple(FEATURES), seed: int = 7, **options) -> DataFrame:
    """Per feature: base items, pairs, and rows the feature could not change."""
    return (
        corrupt_candidates(ids, features, seed, **options)
        .groupBy("feature_name")
        .agg(
            F.count("*").alias("candidates"),
            F.count_if("kept").alias("pairs"),
            F.count_if(~F.col("kept")).alias("dropped"),
        )
    )


def with_changes(pairs: DataFrame) -> DataFrame:
    """Which texts a pair changes, read off its texts."""

    def changed(corrupt: str, clean: str) -> Column:
        return F.coalesce(F.col(corrupt) != F.col(clean), F.lit(False))

    return pairs.withColumns(
        {
            "changed_prompt": changed("corrupt_english_prompt", "english_prompt"),
            "changed_ddl": changed("corrupt_create_statement", "create_statement"),
            "changed_sql": changed("corrupt_sql_statement", "sql_statement"),
        }
    )


def sanity_violations(pairs: DataFrame) -> DataFrame:
    """Pairs that do not change what their feature promises, judged by the texts of any
    table of pairs (a stored one, or all candidates); a healthy table has none."""
    return with_changes(pairs).where(~kept_promise())


def violation_counts(pairs: DataFrame) -> DataFrame:
    """Per feature: the rows of :func:`sanity_violations` and all rows, in one pass."""
    return (
        with_changes(pairs)
        .groupBy("feature_name")
        .agg(F.count_if(~kept_promise()).alias("violations"), F.count("*").alias("candidates"))
    )


CLEAN_PROMPT, CLEAN_LENGTH = "_clean_prompt", "_clean_length"


def _clean_prompt() -> Column:
    return T.prompt_text(F.col("english_prompt"), F.col("create_statement"))


def _corrupt_prompt() -> Column:
    """The corrupt texts where there are some, else the clean ones."""
    english = F.coalesce("corrupt_english_prompt", "english_prompt")
    return T.prompt_text(english, F.coalesce("corrupt_create_statement", "create_statement"))


def _other_prompt() -> Column:
    """Does the corrupt side have a prompt of its own?"""
    return ~(
        F.coalesce("corrupt_english_prompt", "english_prompt").eqNullSafe(F.col("english_prompt"))
        & F.coalesce("corrupt_create_statement", "create_statement").eqNullSafe(F.col("create_statement"))
    )


def _sides(clean: Column) -> dict[str, Column]:
    """Prompt and answer of both sides, given the clean prompt."""
    return {
        "clean_prompt": clean,
        "clean_answer": F.col("sql_statement"),
        "corrupt_prompt": F.when(_other_prompt(), _corrupt_prompt()).otherwise(clean),
        "corrupt_answer": F.coalesce("corrupt_sql_statement", "sql_statement"),
    }


def with_clean_prompt(items: DataFrame) -> DataFrame:
    """Adds the prompt of a base item; ``both_views`` and ``length_check`` then don't make it again for every pair."""
    return with_computed(items, {CLEAN_PROMPT: _clean_prompt()})


def with_clean_length(items: DataFrame, tokenize=K.word_tokens) -> DataFrame:
    """Adds the token length of a base item's prompt, for ``length_check``."""
    return with_computed(items, {CLEAN_LENGTH: F.size(tokenize(_clean_prompt()))})


def both_views(pairs: DataFrame) -> DataFrame:
    """Both sides of each pair side by side, as (prompt, answer) texts."""
    known = pairs if CLEAN_PROMPT in pairs.columns else with_clean_prompt(pairs)
    sides = [text.alias(name) for name, text in _sides(F.col(CLEAN_PROMPT)).items()]
    return known.select("feature_name", "item_id", *sides)


def _view(pairs: DataFrame, side: str) -> DataFrame:
    texts = _sides(_clean_prompt()) | {"corrupt_prompt": _corrupt_prompt()}
    return pairs.select(
        "feature_name", "item_id", texts[f"{side}_prompt"].alias("prompt"),
        texts[f"{side}_answer"].alias("answer"),
    )


def clean_view(pairs: DataFrame) -> DataFrame:
    """The clean side as (prompt, answer) texts."""
    return _view(pairs, "clean")


def corrupt_view(pairs: DataFrame) -> DataFrame:
    """The corrupt side as (prompt, answer) texts."""
    return _view(pairs, "corrupt")


def placed_tokens(items: DataFrame, tokenize=K.word_tokens) -> DataFrame:
    """Adds ``tokens`` (of prompt and answer) and ``prompt_length``: all features of an item look theirs up there."""
    split = with_computed(items, {"_prompt": tokenize(_clean_prompt()), "_answer": tokenize(F.col("sql_statement"))})
    return split.withColumns({"tokens": F.concat("_prompt", "_answer"), "prompt_length": F.size("_prompt")})


def corrupt_positions(
    ids: DataFrame, features=tuple(FEATURES), seed: int = 7, *, tokenize=K.word_tokens, token=lambda word: word,
    keep_tokens: bool = False, **options,
) -> DataFrame:
    """Clean/corrupt pairs with token positions (see ``with_token_positions``); every base item is
    tokenised once, whatever the number of its features."""
    pairs = corrupt_items(ids, features, seed, prepare=lambda base: placed_tokens(base, tokenize), **options)
    return _looked_up(pairs, token, keep_tokens)


def with_token_positions(
    pairs: DataFrame, tokenize=K.word_tokens, token=lambda word: word, keep_tokens: bool = False
) -> DataFrame:
    """Where the clean token stands in the prompt and the answer token behind it; with
    ``keep_tokens`` also the tokens of prompt and answer, as ``tokens``.

    ``tokenize`` maps a text column to a token array and ``token`` a word to its token,
    so a model's tokenizer fits in. Positions are zero-based, -1 when absent. Table
    and field names of the definition are looked up at their second occurrence (the
    prompt names them first), unless synonyms keep them out of the prompt; a separator
    may have one occurrence only. WHERE features search behind the keyword.
    """
    return _looked_up(placed_tokens(pairs, tokenize), token, keep_tokens)


def _looked_up(pairs: DataFrame, token, keep_tokens: bool) -> DataFrame:
    clean, answer, where = token(F.col("clean_token")), token(F.col("answer_token")), token(F.lit("WHERE"))
    # A prompt is short and a pair asks for three tokens at most: reading along the tokens, in compiled
    # code, costs less than sorting them.
    rows = pairs.withColumns({"_clean": clean, "_wanted": answer, "_where": where})
    feature, unknown = F.col("feature_name"), F.lit(K.UNKNOWN)
    synonyms = F.col("table_name.use_synonym") | F.get("table_fields", F.lit(0))["use_synonym"]
    first, second = (K.occurrence(F.col("_prompt"), F.col("_clean"), nth) for nth in (1, 2))
    second = F.when((second < 0) & (feature == "DefFieldSeparator"), first).otherwise(second)
    prompt_at = F.when(feature.isin(*SECOND_OCCURRENCE) & ~synonyms, second).otherwise(first)
    behind = K.behind_first(F.col("_answer"), F.col("_where"), F.col("_clean"))
    in_answer = F.when(feature == "DefWhereField1", behind).otherwise(K.occurrence(F.col("_answer"), F.col("_wanted")))
    found = rows.withColumns({"prompt_token_index": F.coalesce(prompt_at, unknown), "_in_answer": in_answer})
    answer_at = F.when(F.col("_in_answer") >= 0, F.col("prompt_length") + F.col("_in_answer") - 1)
    used = ["_clean", "_wanted", "_where", "_prompt", "_answer", "_in_answer"]
    return found.withColumn("answer_token_index", F.coalesce(answer_at, unknown)).drop(
        *used, *([] if keep_tokens else ["tokens"])
    )


def with_token_ids(pairs: DataFrame, encode, offset: int = 0) -> DataFrame:
    """Vocabulary ids of the clean and corrupt token in a model's tokenizer."""
    first = K.first_token_id(encode, offset)
    return pairs.withColumns(
        {
            "clean_token_id": first(F.col("clean_token")),
            "corrupt_token_id": first(F.col("corrupt_token")),
        }
    )


def length_check(pairs: DataFrame, tokenize=K.word_tokens) -> DataFrame:
    """Token lengths per feature over clean and corrupt prompts; ``lengths`` should be 1. Equal prompts
    are tokenised once, and the clean one once per base item if its length is there (``with_clean_length``)."""
    known = pairs if CLEAN_LENGTH in pairs.columns else with_clean_length(pairs, tokenize)
    other = F.when(_other_prompt(), F.size(tokenize(_corrupt_prompt())))
    both = F.array(F.col(CLEAN_LENGTH), F.coalesce(other, F.col(CLEAN_LENGTH)))
    return (
        known.select("feature_name", F.explode(both).alias("length"))
        .groupBy("feature_name")
        .agg(
            F.count_distinct("length").alias("lengths"),
            F.min("length").alias("shortest"),
            F.max("length").alias("longest"),
        )
    )


def truncate_at_answer(tokens: Column, answer_index: Column) -> Column:
    """Tokens before the answer position."""
    return F.slice(tokens, F.lit(1), F.greatest(answer_index, F.lit(0)))
