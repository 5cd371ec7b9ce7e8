"""Display names, select-field texts and the type rules of the generators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Aggregates each type label admits; any other label takes the default.
NUMERIC_AGGREGATES = ["SUM", "AVG", "MIN", "MAX", "COUNT", ""]
ORDERED_AGGREGATES = ["MIN", "MAX", "COUNT", ""]
DEFAULT_AGGREGATES = ["COUNT", ""]
NUMERIC_TYPES = ["INTEGER", "BIGINT", "DECIMAL", "NUMERIC", "FLOAT", "DOUBLE"]
TEXT_TYPES = ["VARCHAR", "CHAR", "TEXT"]
DATE_TYPES = ["DATE", "DATETIME", "TIMESTAMP"]
# Comparison operators of a WHERE condition and their English words.
RANGE_OPERATORS = ["=", ">", "<", ">=", "<="]
OPERATOR_WORDS = {
    "=": "equal to",
    ">": "greater than",
    "<": "less than",
    ">=": "greater than or equal to",
    "<=": "less than or equal to",
    "LIKE": "containing",
}
# Words of a drawn JSON literal.
JSON_WORDS = ["foo", "bar", "baz", "qux", "test"]


def display_name(named: Column) -> Column:
    """The synonym when the flag says so, else the name (tables, fields, select fields)."""
    return F.when(named["use_synonym"], named["synonym"]).otherwise(named["name"])


def aggregate_text(select: Column) -> Column:
    """``SUM(price)``, or the bare name without an aggregate."""
    return F.when(select["aggregate"] == "", select["name"]).otherwise(
        F.concat(select["aggregate"], F.lit("("), select["name"], F.lit(")"))
    )


def aggregate_alias(select: Column) -> Column:
    """``SUM_price``, or the bare name without an aggregate."""
    return F.when(select["aggregate"] == "", select["name"]).otherwise(
        F.concat(select["aggregate"], F.lit("_"), select["name"])
    )


def select_text(select: Column) -> Column:
    """The field as the SELECT list shows it."""
    return F.when(select["aggregate"] == "", select["name"]).otherwise(
        F.concat(aggregate_text(select), F.lit(" AS "), aggregate_alias(select))
    )
