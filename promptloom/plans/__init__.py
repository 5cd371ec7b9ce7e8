"""Check queries, one module per job."""

from promptloom.plans import corrupt, items, probes, profiles, rewrites, runs, scores  # noqa: F401
from promptloom.plans.base import CHECKS  # noqa: F401
