"""Seeded draws as Column expressions.

Every draw derives from md5 of ``seed:key:slot``, so a row gets the same values on
any partitioning, after any retry, and in any engine that has md5.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst inlines a column that is used once, also when that one use sits in
    a lambda and so runs once per element; binding it avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read but never repeat.

    ``withColumns`` would do, but Catalyst copies a column's expression into every
    filter on it that it pushes down, stage by stage. A condition on the partition's number,
    true in every row, stops that; columns nobody reads are left out all the same, and its
    lambda has Spark compile the projection piece by piece (see ``_list``).
    """
    here = F.exists(F.array(F.spark_partition_id()), lambda number: number >= 0)
    return df.withColumns({name: F.when(here, column) for name, column in columns.items()})


def elements(values: Column, bound: int) -> list[Column]:
    """The elements of an array of at most ``bound``, NULL behind its end."""
    return [F.get(values, F.lit(k)) for k in range(bound)]


def each(values: Column, bound: int, body: Callable[[Column, int], Column]) -> Column:
    """``transform`` of an array of at most ``bound`` elements, spelled out: lambdas are interpreted, this is compiled."""
    size = F.size(values)
    parts = [F.when(size > k, body(element, k)) for k, element in enumerate(elements(values, bound))]
    # the one lambda has Spark compile the projection in small methods (see ``_list``)
    return F.slice(F.array(*parts), F.lit(1), let(size, lambda n: n))


def joined(separator: str, values: Column, bound: int, body: Callable[[Column, int], Column]) -> Column:
    """The texts of :func:`each` in one text, NULL for a NULL array."""
    size = F.size(values)
    parts = [F.when(size > k, body(element, k)) for k, element in enumerate(elements(values, bound))]
    return F.when(F.exists(F.array(values.isNotNull()), lambda known: known), F.concat_ws(separator, *parts))


def text_array(values: Sequence[str]) -> Column:
    """A list of words as one array literal."""
    return F.expr("array(" + ",".join(_quote(v) for v in values) + ")")


def _quote(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---------------------------------------------------------------------- vocabularies
# A vocabulary is never written into a plan: it is the value of a one-row relation, read by index.
_HELD: dict[tuple, Column] = {}


def held(values: Sequence) -> Column:
    """A list (of words, numbers, or dicts with the same keys) as the value of a one-row relation.

    The plan holds a scalar subquery, whose value is sent to each executor once, however long the
    list is. Subqueries can't stand inside lambdas, and a row that carries the value is as wide as
    the list: look up in a projection of its own (``with_computed``), then drop it.
    """
    spark = SparkSession.active()
    app = spark.sparkContext.applicationId
    if _HELD and next(iter(_HELD))[0] != app:
        _HELD.clear()
    key = (app, repr(values))
    if key not in _HELD:
        _HELD[key] = spark.createDataFrame(pa.table({"held": pa.array([list(values)])})).scalar()
    return _HELD[key]


# ------------------------------------------------------------------- one draw per row
# Draws are SQL text, so that building one is a single call of the JVM.
def _name(key: Column | str) -> str:
    """SQL text of a key: a column, or a number."""
    name = key if isinstance(key, str) else key._jc.toString()
    if name.lstrip("-").isdigit():
        return name
    if not name.replace("_", "a").isalnum():
        raise ValueError(f"draws need a column or a number as their key, not an expression: {name}")
    return f"`{name}`"


def digest_sql(seed: int, key: Column | str, *slot: str) -> str:
    parts = [_quote(f"{seed}:"), f"cast({_name(key)} as string)", *[_quote(":" + s) for s in slot]]
    return f"md5(concat({', '.join(parts)}))"


def number_sql(text: str, start: int = 1) -> str:
    return f"cast(conv(substring({text}, {start}, 8), 16, 10) as bigint)"


def draw_sql(seed: int, key: Column | str, slot: str) -> str:
    return number_sql(digest_sql(seed, key, slot))


def digest(seed: int, key: Column | str, *slot: str) -> Column:
    """md5 hex text of ``seed:key[:slot...]``."""
    return F.expr(digest_sql(seed, key, *slot))


def hex_number(text: Column, start: int = 1) -> Column:
    """Eight hex digits from ``start`` as a number in 0 .. 2**32-1."""
    return F.conv(F.substring(text, start, 8), 16, 10).cast("bigint")


def draw(seed: int, key: Column | str, slot: str) -> Column:
    """One 32-bit draw per key and slot."""
    return F.expr(draw_sql(seed, key, slot))


def draw_below(n: int | Column, seed: int, key: Column | str, slot: str) -> Column:
    """Uniform integer in 0 .. n-1."""
    if isinstance(n, int):
        return F.expr(f"cast({draw_sql(seed, key, slot)} % {n} as int)")
    return (draw(seed, key, slot) % n).cast("int")


def chance(p: float, seed: int, key: Column | str, slot: str) -> Column:
    """True with probability ``p`` (resolution one millionth)."""
    return draw_below(1_000_000, seed, key, slot) < F.lit(round(p * 1_000_000))


def pick(values: Column, seed: int, key: Column | str, slot: str) -> Column:
    """One element of an array; NULL when it is empty."""
    return F.get(values, draw_below(F.greatest(F.size(values), F.lit(1)), seed, key, slot))


def word_at(words: Sequence[str], number: Column) -> Column:
    """The word of a short fixed list that a drawn number falls on."""
    return F.get(text_array(words), (number % F.lit(len(words))).cast("int"))


def pick_word(words: Sequence[str], seed: int, key: Column | str, slot: str) -> Column:
    """One word of a vocabulary. Not for use inside a lambda."""
    return F.get(held(words), draw_below(len(words), seed, key, slot))


def pick_short(words: Sequence[str], seed: int, key: Column | str, slot: str) -> Column:
    """One word of a short fixed list, also inside a lambda."""
    return word_at(words, draw(seed, key, slot))


def choice_width(rows: Sequence[Sequence]) -> int:
    """How much of a drawn number is used up by a choice from any of the lists."""
    return lcm(*[len(r) for r in rows])


# ------------------------------------------------------------------ many draws per row
# One md5 serves four numbers. The arrays are spelled out element by element, because
# lambdas over arrays are interpreted and these expressions are the costly ones: keep
# them in a projection of their own and let lambdas read the finished columns.
def _list(parts: Sequence[str], kind: str) -> str:
    """SQL text of an array of drawn values. A long one is joined with an empty array that a lambda makes:
    Spark then compiles the projection in many small methods. One method for all of it, as in whole-stage
    code, takes more than 64 KB or is too long for the JVM to optimise."""
    array = f"array({', '.join(parts)})"
    return array if len(parts) <= 4 else f"concat({array}, filter(array(cast(null as {kind})), v -> v is not null))"


def _blocks(seed: int, key: Column | str, slot: str, count: int) -> list[str]:
    return [digest_sql(seed, key, slot, str(j)) for j in range(count)]


def digests(seed: int, key: Column | str, slot: str, count: int) -> Column:
    """Array of md5 of ``seed:key:slot:0``, ``...:1`` and so on."""
    return F.expr(f"array({', '.join(_blocks(seed, key, slot, count))})")


def block_columns(seed: int, key: Column | str, slot: str, count: int) -> dict[str, Column]:
    """The digests that ``count`` numbers or sort keys of a slot are read from, as columns of an earlier projection."""
    return {f"_d_{slot}_{j}": F.expr(sql) for j, sql in enumerate(_blocks(seed, key, slot, (count + 3) // 4))}


def _values(seed: int, key: Column | str, slot: str, count: int, used: str | None, kind: str, value: Callable[[str, int], str]) -> Column:
    """An array of values read from digests. With ``used`` (SQL text: how many of them the row reads) the digests are
    ``block_columns``, and the values behind are NULL and cost nothing."""
    if used is None:
        blocks = _blocks(seed, key, slot, (count + 3) // 4)
    else:
        blocks = [f"`{name}`" for name in block_columns(seed, key, slot, count)]
    parts = [value(blocks[k // 4], k) for k in range(count)]
    if used is not None:
        parts = [f"if({k} < {used}, {part}, null)" for k, part in enumerate(parts)]
    return F.expr(_list(parts, kind))


def numbers(seed: int, key: Column | str, slot: str, count: int, used: str | None = None) -> Column:
    """``count`` 32-bit numbers; NULL behind the first ``used`` of them."""
    return _values(seed, key, slot, count, used, "bigint", lambda block, k: number_sql(block, 1 + 8 * (k % 4)))


def sort_keys(seed: int, key: Column | str, slot: str, count: int, used: str | None = None) -> Column:
    """``count`` keys whose order is a drawn order; each ends in its index, as wide as it must be. NULL behind the
    first ``used`` of them."""
    width = max(3, len(str(count - 1)))

    def value(block: str, k: int) -> str:
        return f"concat(substring({block}, {1 + 8 * (k % 4)}, 8), '{k:0{width}d}')"

    return _values(seed, key, slot, count, used, "string", value)


def rest(number: Column, divisor: int) -> Column:
    """What is left of a drawn number once ``number % divisor`` is used up."""
    return F.shiftright(number, divisor.bit_length())


def indices(count: Column) -> Column:
    """0 .. count-1; empty for a count below 1."""
    return F.when(count < 1, F.expr("cast(array() as array<int>)")).otherwise(
        F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)
    )


def sample_order(values: Column, keys: Column, count: Column) -> Column:
    """The sort keys of ``count`` elements without replacement, in drawn order."""
    return F.slice(F.sort_array(F.slice(keys, F.lit(1), F.size(values))), F.lit(1), count)


def sampled(values: Column, key: Column) -> Column:
    """The element that a sort key stands for."""
    return F.get(values, F.substring(key, 9, 10).cast("int"))


def sample_array(values: Column, keys: Column, count: Column) -> Column:
    """``count`` elements without replacement, in the order of the drawn sort keys."""
    return F.transform(sample_order(values, keys, count), lambda k: sampled(values, k))


def strides(n: int) -> list[int]:
    """Steps that visit all of 0 .. n-1 when repeated modulo n."""
    return [s for s in range(1, max(n, 2)) if gcd(s, n) == 1]


def sample_start(n: int, seed: int, key: Column | str, slot: str) -> tuple[Column, Column]:
    """(start, step) of ``sample_indices``. Not for use inside a lambda."""
    steps = strides(n)
    at = draw_below(len(steps), seed, key, slot + "_stride")
    step = at + 1 if steps == list(range(1, len(steps) + 1)) else F.get(held(steps), at).cast("int")
    return draw_below(n, seed, key, slot + "_start"), step


def sample_indices(n: int, count: Column, start: Column, step: Column) -> Column:
    """``count`` different indices below ``n`` (at most n), at O(1) per index.

    A drawn start and a drawn step coprime to ``n``. Each index is uniform; the
    joint distribution covers start/step pairs, not all permutations.
    """
    return let(
        F.struct(start.alias("start"), step.alias("step"), count.alias("n")),
        lambda b: F.transform(
            indices(b["n"]), lambda k: ((b["start"] + k.cast("bigint") * b["step"]) % F.lit(n)).cast("int")
        ),
    )
