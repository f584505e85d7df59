"""Registered queries: one per operator, each with the SQL that gives the same rows where SQL can."""

from quasi.queries import (  # noqa: F401
    aggregation,
    columns,
    effects,
    evaluation,
    modelling,
    scans,
    shaping,
    weights,
)
from quasi.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
