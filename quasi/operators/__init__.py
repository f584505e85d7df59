"""Relational operators: reshaping, joins, aggregation, windows, sampling and metrics."""
