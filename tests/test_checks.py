"""A part of the check queries against DuckDB; ``check.py`` runs them all."""

import pytest

import __spark_entry__ as entry
from check import compare
from promptloom.plans import CHECKS

QUICK = (
    "items_cs4", "scores_cs3", "corrupt_definition", "prompt_rewrites", "sql_similarity",
    "unigram_counts", "token_coverage", "exact_splits", "consistent_edges", "important_heads",
    "stopping_points", "latest_run_metrics", "rotated_partners", "flat_rows", "corrupt_aggregate",
    "corrupt_order", "similarity_by_kind", "edge_documents", "probe_vectors", "target_ranks",
)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    line = compare(spark, name, sf)
    assert line.startswith("ok") and not line.startswith("ok  0 rows"), line


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_its_sql(spark):
    assert not {name for name, c in CHECKS.items() if c.sql is None}
    assert set(CHECKS) <= set(entry.queries())
