"""Similarity of two SQL texts by their visible parts, in three point schemes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from promptloom.functions.draws import let
from promptloom.functions.scoring import point
from promptloom.functions.text import blank_words

ORDER_MARK = "ORDER BY"


def _has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def _between(text: Column) -> Column:
    """Text between SELECT and FROM. A missing FROM cuts the last character off; a
    missing SELECT starts at the seventh."""
    start = F.instr(text, F.lit("SELECT")) + F.lit(6)
    end = F.when(_has(text, "FROM"), F.instr(text, F.lit("FROM")) - 1).otherwise(F.length(text) - 1)
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def _behind(text: Column, word: str) -> Column:
    """Text behind the word and one more character; without the word, from its length on."""
    return F.substr(text, F.instr(text, F.lit(word)) + F.lit(len(word) + 1))


def _columns(text: Column) -> Column:
    return F.transform(F.split(F.trim(_between(text)), ","), lambda c: F.trim(c))


def _word(text: Column, at: int) -> Column:
    return F.get(blank_words(text), F.lit(at))


def _select_points(a: Column, b: Column) -> Column:
    """Keywords in both, same first column, same second column (when both have two)."""
    columns = F.struct(_columns(a).alias("a"), _columns(b).alias("b"))
    same = let(
        columns,
        lambda c: point(F.get(c["a"], F.lit(0)) == F.get(c["b"], F.lit(0)))
        + point(F.coalesce(F.get(c["a"], F.lit(1)) == F.get(c["b"], F.lit(1)), F.lit(False))),
    )
    return point(_has(a, "SELECT") & _has(b, "SELECT")) + point(_has(a, "FROM") & _has(b, "FROM")) + same


def five_point_similarity(a: Column, b: Column) -> Column:
    """SELECT, FROM, text after FROM, first and second column: a fifth each."""
    rest = point(F.trim(_behind(a, "FROM")) == F.trim(_behind(b, "FROM")))
    return (_select_points(a, b) + rest) / F.lit(5.0)


def eight_point_similarity(a: Column, b: Column) -> Column:
    """Adds ORDER BY in both, its first column and its direction: an eighth each."""

    def ordered(text: Column) -> Column:
        return F.when(_has(text, ORDER_MARK), blank_words(_behind(text, ORDER_MARK)))

    words = F.struct(ordered(a).alias("a"), ordered(b).alias("b"))

    def order_points(w: Column) -> Column:
        column = F.get(w["a"], F.lit(0)) == F.get(w["b"], F.lit(0))
        direction = F.upper(F.get(w["a"], F.lit(1))) == F.upper(F.get(w["b"], F.lit(1)))
        return point(F.coalesce(column, F.lit(False))) + point(F.coalesce(direction, F.lit(False)))

    table = point(
        F.substring_index(_behind(a, "FROM"), " ", 1) == F.substring_index(_behind(b, "FROM"), " ", 1)
    )
    both = point(_has(a, ORDER_MARK) & _has(b, ORDER_MARK))
    return (_select_points(a, b) + table + both + let(words, order_points)) / F.lit(8.0)


def clause_similarity(a: Column, b: Column) -> Column:
    """Agreement on clauses, earned over possible; the possible points vary.

    ``AS`` is looked for as a substring, so ``ASC`` counts as one.
    """

    def count_as(text: Column) -> Column:
        return F.floor((F.length(text) - F.length(F.replace(text, F.lit("AS"), F.lit("")))) / 2)

    def last_as_word(text: Column) -> Column:
        return _word(F.substring_index(text, "AS", -1), 0)

    def score(s: Column) -> Column:
        x, y = s["a"], s["b"]
        agree, earned, possible = {}, F.lit(0), F.lit(4)
        for word in ("SELECT", "FROM", ORDER_MARK, "AS"):
            agree[word] = (_has(x, word), _has(y, word))
            earned = earned + point(_has(x, word) == _has(y, word))
        earned = earned + F.least(count_as(x), count_as(y))
        possible = possible + F.greatest(count_as(x), count_as(y))
        compared = {
            "FROM": (_word(_behind(x, "FROM"), 0), _word(_behind(y, "FROM"), 0)),
            ORDER_MARK: (_word(_behind(x, ORDER_MARK), 0), _word(_behind(y, ORDER_MARK), 0)),
            "AS": (last_as_word(x), last_as_word(y)),
        }
        for word, (left, right) in compared.items():
            one, other = agree[word]
            possible = possible + point(one | other)
            earned = earned + point(one & other & F.coalesce(left == right, F.lit(False)))
        whole = agree["SELECT"][0] & agree["FROM"][0] & agree["SELECT"][1] & agree["FROM"][1]
        comma = (_has(_between(x), ","), _has(_between(y), ","))
        earned = earned + point(whole & comma[0] & comma[1])
        possible = possible + point(whole & (comma[0] | comma[1]))

        def pairs(c: Column) -> Column:
            equal = F.aggregate(
                c["a"], F.lit(0), lambda n, p: n + F.size(F.filter(c["b"], lambda q: q == p))
            )
            return F.struct(equal.alias("equal"), F.greatest(F.size(c["a"]), F.size(c["b"])).alias("most"))

        columns = F.struct(_columns(x).alias("a"), _columns(y).alias("b"))
        return let(
            let(columns, pairs),
            lambda p: (earned + F.when(whole, p["equal"]).otherwise(0))
            / (possible + F.when(whole, p["most"]).otherwise(0)),
        )

    return let(F.struct(F.trim(a).alias("a"), F.trim(b).alias("b")), score)
