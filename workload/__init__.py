"""Queries of the engine over the supplied star-schema tables, each next to its SQL oracle."""

from __future__ import annotations


def load():
    """(queries, oracles) of all modules."""
    from workload import registry
    from workload import aggregates, joins, models, pipelines, regressions, scenarios, tables  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLES)
