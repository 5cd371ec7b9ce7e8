"""Text expressions shared by the jobs. All replacements are literal, never regex."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from promptloom.functions.draws import let

# The blanks that whitespace normalisation joins (Unicode blanks
# included; a backslash-s alone would cover ASCII only).
# A visible ASCII character is told by one look, not by trying all of the class.
BLANKS = "[[^!-~]&&[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]+"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The prompt layout.
INSTRUCTION_MARK = "### Instruction:"
CONTEXT_MARK = "### Context:"
RESPONSE_MARK = "### Response:"


def squish(text: Column) -> Column:
    """Runs of blanks become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def no_punctuation(text: Column) -> Column:
    """Each punctuation character becomes a space."""
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


# What a word is made of (letters and digits of any script, underscore).
WORD = "([\\p{L}\\p{N}_]+)"


def words_of(text: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def blank_words(text: Column) -> Column:
    """Pieces between blanks; an empty text has none."""
    return let(
        squish(text),
        lambda t: F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(
            F.split(t, " ")
        ),
    )



def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence; unchanged when there is none."""
    at = F.instr(text, old)
    return let(
        F.struct(text.alias("t"), old.alias("o"), new.alias("n"), at.alias("at")),
        lambda s: F.when(s["at"] < 1, s["t"]).otherwise(
            F.concat(
                F.left(s["t"], s["at"] - 1),
                s["n"],
                F.substr(s["t"], s["at"] + F.length(s["o"])),
            )
        ),
    )



def after_first(text: Column, mark: str) -> Column:
    """Text behind the first ``mark``; NULL without it."""
    return F.when(
        F.contains(text, F.lit(mark)),
        F.substr(text, F.instr(text, F.lit(mark)) + F.lit(len(mark))),
    )


def before_first(text: Column, mark: str) -> Column:
    """Text before the first ``mark``; the whole text without it."""
    return F.substring_index(text, mark, 1)


def replace_first_after(text: Column, mark: str, old: Column, new: Column) -> Column:
    """Replace the first ``old`` behind the first ``mark``; unchanged without the mark."""
    return F.when(
        F.contains(text, F.lit(mark)),
        F.concat(
            before_first(text, mark), F.lit(mark), replace_first(after_first(text, mark), old, new)
        ),
    ).otherwise(text)


def base_type(sql_type: Column) -> Column:
    """``VARCHAR(50)`` → ``VARCHAR``."""
    return F.substring_index(F.upper(sql_type), "(", 1)


def prompt_text(english: Column, create: Column) -> Column:
    """The prompt with its three marks, normalised, ending in one space."""
    return F.concat(squish(raw_prompt(english, create)), F.lit(" "))


def raw_prompt(english: Column, create: Column) -> Column:
    """The prompt as it is, blanks kept."""
    return F.concat(
        F.lit(INSTRUCTION_MARK + " "),
        english,
        F.lit(" " + CONTEXT_MARK + " "),
        create,
        F.lit(" " + RESPONSE_MARK + " "),
    )


def training_text(english: Column, create: Column, sql: Column) -> Column:
    """Prompt and answer in one text."""
    return F.concat(raw_prompt(english, create), sql)


def schema_and_answer(create: Column, sql: Column) -> Column:
    return F.concat_ws("\n", create, sql)


def prompt_part(text: Column) -> Column:
    """Everything up to and with the response mark."""
    return F.concat(before_first(text, "Response: "), F.lit("Response: "))


def answer_part(text: Column) -> Column:
    """The piece between the first and second response mark; NULL without a mark."""
    return F.get(F.split(text, "Response: "), F.lit(1))


def answer_from_select(text: Column) -> Column:
    """The piece between the first and second SELECT, with the keyword; NULL without one."""
    return F.concat(F.lit("SELECT"), F.get(F.split(text, "SELECT"), F.lit(1)))


def continuation(output: Column, prompt: Column) -> Column:
    """Decoded output behind the prompt."""
    return F.substr(output, F.length(prompt) + 1)


# Where a table name stands in a prompt.
CREATE_NAME = "(?i)CREATE\\s+TABLE\\s+([A-Za-z_][A-Za-z0-9_]*)"
FROM_NAME = "(?i)\\bFROM\\s+([A-Za-z_][A-Za-z0-9_]*)"


def table_names_of(prompt: Column) -> Column:
    """Names after CREATE TABLE and FROM, lower-cased, each once, sorted."""
    found = F.array(
        F.lower(F.regexp_extract(prompt, CREATE_NAME, 1)),
        F.lower(F.regexp_extract(prompt, FROM_NAME, 1)),
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n != "")))


def rename_node(name: Column) -> Column:
    """``mlp.3`` → ``l3.mlp``; ``head.1.4.q`` → ``l1.h4.q``; ``head.0.2`` → ``l0.h2``."""
    name = F.regexp_replace(name, "^mlp\\.([^.]*).*$", "l$1.mlp")
    return F.regexp_replace(name, "^head\\.([^.]*)\\.([^.]*)(?:(\\.[^.]+).*)?$", "l$1.h$2$3")


def layer_of(name: Column) -> Column:
    """Layer number in a raw node name; 0 for a node without a dot."""
    return F.when(
        F.contains(name, F.lit(".")), F.get(F.split(name, "\\."), F.lit(1)).cast("int")
    ).otherwise(F.lit(0))


def head_label(layer: Column, head: Column) -> Column:
    return F.concat(F.lit("L"), layer.cast("string"), F.lit("_H"), head.cast("string"))
