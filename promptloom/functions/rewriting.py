"""Prompt rewrites as Column expressions.

Swaps of table and field in the instruction give NULL when a name is not found; all
other rewrites then leave the prompt unchanged. Words are whole words: a name that
contains another one, or a marker word, is never torn apart. Names are replaced at
their first occurrence only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from promptloom.functions.draws import let, pick_short
from promptloom.functions.text import (
    CONTEXT_MARK, INSTRUCTION_MARK, RESPONSE_MARK, after_first, before_first, replace_first,
)
from promptloom.sources.vocabulary import PAIRS

# Where names stand in the prompt of a base item.
TABLE_SAID = "\\bfrom the (\\w+)"
FIRST_SAID = "\\bshow me the (\\w+)"
SECOND_SAID = "\\band (\\w+)"
FIRST_ASKED = "\\b(?:show|select|get|display)\\s+(?:me the\\s+)?(\\w+)"
SECOND_ASKED = "\\band\\s+(\\w+)"
TABLE_DEFINED = "CREATE TABLE (\\w+)"
FIRST_DEFINED = "\\(\\s*(\\w+)"
SECOND_DEFINED = ",\\s*(\\w+)"
PLACEHOLDER = "TEMP"
# Words of the function-word rewrite and of the sweeps.
FUNCTION_WORDS = {"select": "rose", "the": "hit", "and": "under", "from": "sky", "table": "one"}
SWEEP_WORDS = (
    "select", "show", "pick", "find", "pull", "grab", "take", "move", "walk", "run", "jump",
    "stop", "sing", "fly", "create",
)
SWEEP_SEPARATORS = (
    ",", ";", "&", "|", ":", "#", "@", "$", "^", "~", "+", "->", "=>", "--", "//", "and",
)


def found(text: Column, pattern: str) -> Column:
    """First group of the first match; NULL without a match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def between(text: Column, start: str, end: str) -> Column:
    """Text between two marks; NULL when one of them is missing."""
    tail = after_first(text, start)
    return F.when(F.contains(tail, F.lit(end)), before_first(tail, end))


def instruction_of(text: Column) -> Column:
    return between(text, INSTRUCTION_MARK, CONTEXT_MARK)


def context_of(text: Column) -> Column:
    return between(text, CONTEXT_MARK, RESPONSE_MARK)


def replace_first_word(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence of a name as a whole word replaced; unchanged without one."""

    def replaced(s: Column) -> Column:
        at = F.regexp_instr(s["t"], F.concat(F.lit("\\b"), s["o"], F.lit("\\b")))
        return let(
            F.struct(s["t"].alias("t"), s["o"].alias("o"), s["n"].alias("n"), at.alias("at")),
            lambda b: F.when(b["at"] < 1, b["t"]).otherwise(
                F.concat(
                    F.left(b["t"], b["at"] - 1), b["n"], F.substr(b["t"], b["at"] + F.length(b["o"]))
                )
            ),
        )

    return let(F.struct(text.alias("t"), old.alias("o"), new.alias("n")), replaced)


def replace_words(text: Column, old: str, new: Column) -> Column:
    """Every occurrence of a word (as a whole word) or of a sign replaced."""
    parts = F.split(text, f"\\b{old}\\b" if old.isalpha() else re.escape(old))

    def rejoined(s: Column) -> Column:
        behind = F.transform(
            F.slice(s["p"], F.lit(2), F.size(s["p"])), lambda p: F.concat(s["n"], p)
        )
        return F.concat(F.get(s["p"], F.lit(0)), F.array_join(behind, ""))

    return let(F.struct(parts.alias("p"), new.alias("n")), rejoined)


def swap(text: Column, table: Column, field: Column) -> Column:
    """Exchange the first occurrences of the two words, through a placeholder."""
    text = replace_first_word(text, field, F.lit(PLACEHOLDER))
    text = replace_first_word(text, table, field)
    return replace_first(text, F.lit(PLACEHOLDER), table)


def swap_in_instruction(text: Column, field_pattern: str) -> Column:
    names = F.struct(
        found(F.lower(instruction_of(text)), TABLE_SAID).alias("table"),
        found(F.lower(instruction_of(text)), field_pattern).alias("field"),
    )
    return let(
        names,
        lambda n: F.when(
            n["table"].isNotNull() & n["field"].isNotNull(), swap(text, n["table"], n["field"])
        ),
    )


def edit_context(text: Column, make: Callable[[Column], Column]) -> Column:
    """The prompt with its context section edited; unchanged where the edit gives NULL."""
    tail = F.get(F.split(text, RESPONSE_MARK), F.lit(1))

    def rebuilt(section: Column) -> Column:
        return F.concat(
            before_first(text, CONTEXT_MARK), F.lit(CONTEXT_MARK), make(section),
            F.lit(RESPONSE_MARK), tail,
        )

    return F.coalesce(let(context_of(text), rebuilt), text)


def swap_in_context(text: Column, field_pattern: str) -> Column:
    def swapped(section: Column) -> Column:
        names = F.struct(
            found(section, TABLE_DEFINED).alias("t"), found(section, field_pattern).alias("f")
        )
        return let(
            names,
            lambda n: F.when(
                n["t"].isNotNull() & n["f"].isNotNull(), swap(section, n["t"], n["f"])
            ),
        )

    return edit_context(text, swapped)


def replace_in_instruction(text: Column, field: Column, word: Column) -> Column:
    """The first occurrence before the context mark, replaced by a word."""
    head = before_first(text, CONTEXT_MARK)
    tail = F.substr(text, F.length(head) + 1)
    return F.when(field.isNull(), text).otherwise(F.concat(replace_first_word(head, field, word), tail))


def replace_in_context(text: Column, pattern: str, word: Column) -> Column:
    def replaced(section: Column) -> Column:
        return let(
            found(section, pattern),
            lambda f: F.when(f.isNotNull(), replace_first_word(section, f, word)),
        )

    return edit_context(text, replaced)


def replace_function_words(text: Column) -> Column:
    """Function words in the instruction replaced, everywhere they occur in it."""
    section = instruction_of(text)
    for old, new in FUNCTION_WORDS.items():
        section = F.regexp_replace(section, f"\\b{old}\\b", new)
    head = F.concat(before_first(text, INSTRUCTION_MARK), F.lit(INSTRUCTION_MARK))
    tail = F.concat(F.lit(CONTEXT_MARK), after_first(after_first(text, INSTRUCTION_MARK), CONTEXT_MARK))
    return F.coalesce(F.concat(head, section, tail), text)


def _field_asked(text: Column, place: int) -> Column:
    section = F.lower(instruction_of(text))
    if place == 1:
        return found(before_first(section, "from"), FIRST_ASKED)
    return found(section, SECOND_ASKED)


def rewrites(seed: int, key: Column, words=PAIRS.random_words) -> dict[str, Callable]:
    """Rewrite name → function of the prompt column; random words are drawn per row."""

    def word(slot: str) -> Column:
        return pick_short(words, seed, key, slot)

    return {
        "SwapEng1": lambda t: swap_in_instruction(t, FIRST_SAID),
        "SwapEng2": lambda t: swap_in_instruction(t, SECOND_SAID),
        "SwapCreate1": lambda t: swap_in_context(t, FIRST_DEFINED),
        "SwapCreate2": lambda t: swap_in_context(t, SECOND_DEFINED),
        "RandomEng1": lambda t: replace_in_instruction(t, _field_asked(t, 1), word("r_eng1")),
        "RandomEng2": lambda t: replace_in_instruction(t, _field_asked(t, 2), word("r_eng2")),
        "RandomCreate1": lambda t: replace_in_context(t, FIRST_DEFINED, word("r_create1")),
        "RandomCreate2": lambda t: replace_in_context(t, SECOND_DEFINED, word("r_create2")),
        "FunctionWords": replace_function_words,
    }


# Sweep name → (word replaced, words put in its place).
SWEEPS = {
    "EngFieldStart": ("select", SWEEP_WORDS),
    "DefCreateTable": ("CREATE", tuple(w.upper() for w in SWEEP_WORDS)),
    "EngFieldSeparator": ("and", SWEEP_SEPARATORS),
    "DefFieldSeparator": (",", SWEEP_SEPARATORS),
}

# Patterns of the parts of a prompt with its answer.
PART_PATTERNS = {
    "instruction_table": ("from the (\\w+) table", 1),
    "instruction_field1": ("show me the (\\w+) and (\\w+) from", 1),
    "instruction_field2": ("show me the (\\w+) and (\\w+) from", 2),
    "context_table": ("CREATE TABLE\\s+(\\w+)\\s*\\(\\s*(\\w+)\\s+\\w+,\\s*(\\w+)\\s+\\w+\\s*\\)", 1),
    "context_field1": ("CREATE TABLE\\s+(\\w+)\\s*\\(\\s*(\\w+)\\s+\\w+,\\s*(\\w+)\\s+\\w+\\s*\\)", 2),
    "context_field2": ("CREATE TABLE\\s+(\\w+)\\s*\\(\\s*(\\w+)\\s+\\w+,\\s*(\\w+)\\s+\\w+\\s*\\)", 3),
    "response_table": ("FROM (\\w+)", 1),
    "response_field1": ("SELECT\\s+(\\w+),\\s*(\\w+)", 1),
    "response_field2": ("SELECT\\s+(\\w+),\\s*(\\w+)", 2),
}


def prompt_parts(text: Column) -> dict[str, Column]:
    """Tables and two fields of instruction, context and response; NULL when missing."""
    return {
        name: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
        for name, (pattern, group) in PART_PATTERNS.items()
    }
