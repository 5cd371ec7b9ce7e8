"""Registry of the check queries and their shared inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptloom.operators.generate import generate_items
from promptloom.sources.tables import spread, table


@dataclass(frozen=True)
class Check:
    """A query, the SQL that must give the same rows, and the operators it covers."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


CHECKS: dict[str, Check] = {}


def check(name: str, covers: str, sql: str | Callable[[], str] | None = None):
    """Register a query. ``covers`` lists inventory ids, separated by blanks."""

    def wrap(function):
        if name in CHECKS:
            raise ValueError(f"query registered twice: {name}")
        CHECKS[name] = Check(function, sql() if callable(sql) else sql, covers)
        return function

    return wrap


# The standard items of the check queries: one per order, synonyms on.
ITEM_OPTIONS = {"use_synonyms_table": True, "use_synonyms_field": True}
_ITEMS: dict[tuple, DataFrame] = {}


def order_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys as item ids, spread over the cores (generation is all CPU)."""
    return spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id")))


def items(spark: SparkSession, sf: str, csn: int, **options) -> DataFrame:
    """The plan of the standard items; building a plan once per session saves time. Plans
    of a session before are dropped."""
    if _ITEMS and next(iter(_ITEMS))[0] != spark.sparkContext.applicationId:
        _ITEMS.clear()
    key = (spark.sparkContext.applicationId, sf, csn, tuple(sorted(options.items())))
    if key not in _ITEMS:
        _ITEMS[key] = generate_items(order_ids(spark, sf), csn, **{**ITEM_OPTIONS, **options})
    return _ITEMS[key]


def r6(column):
    """Six decimals: averages then agree between engines."""
    return F.round(column, 6)
