"""Points of a predicted SQL text against its item, as Column expressions.

A score is earned / possible points. ``possible`` varies, because checks that have
nothing to look at are left out. Texts are compared upper-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from promptloom.functions import names as N
from promptloom.functions.draws import let
from promptloom.functions.text import squish

# Points by number of unknown words, and by surplus characters
# (upper limit, points); beyond the last limit there are none.
UNKNOWN_WORD_POINTS = ((0, 10), (1, 8), (2, 6), (4, 4), (8, 2))
SURPLUS_LENGTH_POINTS = ((2, 10), (4, 8), (6, 6), (8, 4), (10, 2))
STEP_POINTS = 10
ORDER_MARK = "ORDER BY"


def point(condition: Column) -> Column:
    """One point when the condition holds."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def points_by_step(number: Column, steps) -> Column:
    expr = None
    for limit, points in steps:
        expr = (F if expr is None else expr).when(number <= limit, F.lit(points))
    return expr.otherwise(F.lit(0))


def normalised(prediction: Column) -> Column:
    """Blanks joined, upper case; NULL counts as empty."""
    return F.upper(squish(F.coalesce(prediction, F.lit(""))))


def sql_tokens(text: Column) -> Column:
    """Pieces between spaces, commas stripped at both ends of each piece.

    ``text`` has no blank runs. Splitting on a space with its neighbouring commas
    strips the pieces in the same pass.
    """
    trimmed = F.trim(text)
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(
        F.split(F.btrim(trimmed, F.lit(",")), ",* ,*")
    )


def unknown_words(tokens: Column, known: Column) -> Column:
    """How many tokens are not in ``known`` (an array bound outside the lambda)."""
    return F.size(F.filter(tokens, lambda t: ~F.array_contains(known, t)))


def unknown_word_points(tokens: Column, known: Column) -> Column:
    return points_by_step(unknown_words(tokens, known), UNKNOWN_WORD_POINTS)


def length_points(part: Column, truth: Column) -> Column:
    """Surplus of the part before the first ORDER BY over the *whole* ground truth."""
    return points_by_step(F.length(part) - F.length(truth), SURPLUS_LENGTH_POINTS)


def head_part(text: Column) -> Column:
    """Text before the first ORDER BY."""
    return F.substring_index(text, ORDER_MARK, 1)


def order_part(text: Column) -> Column:
    """The first ORDER BY clause up to a second one; empty when there is none."""
    piece = F.get(F.split(text, ORDER_MARK), F.lit(1))
    return F.when(piece.isNull(), F.lit("")).otherwise(F.concat(F.lit(ORDER_MARK + " "), F.ltrim(piece)))


def upper_names(fields: Column, text) -> Column:
    return F.transform(fields, lambda f: F.upper(text(f)))


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def select_points(
    part: Column, tokens: Column, truth: Column, table: Column, shown: Column,
    aliases: Column | None = None,
) -> Column:
    """(earned, possible) of the SELECT .. FROM part.

    ``shown`` are the texts of the select fields (bare names, or ``AGG(F)`` in set 3)
    and ``aliases`` the texts after AS that set 3 expects.
    """
    no_alias = F.expr("cast(array() as array<string>)")
    bound = F.struct(
        tokens.alias("t"),
        shown.alias("f"),
        (no_alias if aliases is None else aliases).alias("a"),
        table.alias("table"),
        F.array_position(tokens, "SELECT").alias("select_at"),
        F.array_position(tokens, "FROM").alias("from_at"),
        F.array_position(tokens, table).alias("table_at"),
        length_points(part, truth).alias("length_points"),
    )

    def total(s: Column) -> Column:
        has_select, has_from, has_table = s["select_at"] > 0, s["from_at"] > 0, s["table_at"] > 0
        keywords = ["SELECT", "FROM"] if aliases is None else ["SELECT", "AS", "FROM"]
        words = F.array(*[F.lit(k) for k in keywords], s["table"])
        known = F.concat(words, s["f"]) if aliases is None else F.concat(words, s["f"], s["a"])
        fields = F.size(s["f"])
        present = count_where(s["f"], lambda f: F.array_contains(s["t"], f))
        alias_present = count_where(s["a"], lambda a: F.array_contains(s["t"], a))
        # A field stands after SELECT when its first position does; an absent one passes.
        placed = count_where(
            s["f"],
            lambda f: let(
                F.array_position(s["t"], f), lambda at: (at == 0) | (at > s["select_at"])
            ),
        )
        # FROM stands after all fields when no field is left behind it.
        behind = F.slice(s["t"], F.greatest(s["from_at"].cast("int"), F.lit(1)), F.size(s["t"]))
        clear = ~F.arrays_overlap(behind, s["f"])
        earned = (
            point(has_select) + point(has_table) + point(has_from) + point(s["select_at"] == 1)
            + s["length_points"] + present + alias_present
            + F.when(has_select, placed).otherwise(0)
            + point(has_from & clear)
            + point(has_from & has_table & (s["table_at"] > s["from_at"]))
            + let(known, lambda k: unknown_word_points(s["t"], k))
        )
        possible = (
            F.lit(4 + STEP_POINTS + STEP_POINTS) + fields + F.size(s["a"])
            + F.when(has_select, fields).otherwise(0)
            + point(has_from) + point(has_from & has_table)
        )
        return F.struct(earned.alias("earned"), possible.alias("possible"))

    return let(bound, total)


def order_points(part: Column, order_by: Column) -> Column:
    """(earned, possible) of the ORDER BY clause; nothing of nothing when it is empty."""
    none = F.struct(F.lit(0).alias("earned"), F.lit(0).alias("possible"))
    bound = F.struct(
        sql_tokens(part).alias("t"),
        F.coalesce(upper_names(order_by, lambda f: f["name"]), F.array().cast("array<string>"))
        .alias("f"),
    )

    def total(s: Column) -> Column:
        words = F.array(*[F.lit(w) for w in ("ORDER", "BY", "ASC", "DESC")])
        starts = (F.get(s["t"], F.lit(0)) == "ORDER") & (F.get(s["t"], F.lit(1)) == "BY")
        present = count_where(s["f"], lambda f: F.array_contains(s["t"], f))
        earned = (
            point(starts) + present
            + let(F.concat(words, s["f"]), lambda k: unknown_word_points(s["t"], k))
        )
        return F.struct(
            earned.alias("earned"), (F.lit(1 + STEP_POINTS) + F.size(s["f"])).alias("possible")
        )

    return F.when(part == "", none).otherwise(let(bound, total))


def plain_fields(select: Column) -> Column:
    return upper_names(select, lambda f: f["name"])


def aggregate_fields(select: Column) -> Column:
    return upper_names(select, N.aggregate_text)


def aggregate_aliases(select: Column) -> Column:
    return upper_names(F.filter(select, lambda f: f["aggregate"] != ""), N.aggregate_alias)
