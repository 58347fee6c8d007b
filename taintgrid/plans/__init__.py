"""Plans over the star-schema tables."""

from __future__ import annotations

import importlib

MODULES = ["fact_queries", "exports", "graph_queries", "finding_queries", "rule_queries"]


def all_cases():
    """(queries, checks) of every plan module."""
    from taintgrid.plans import cases

    for name in MODULES:
        importlib.import_module(f"taintgrid.plans.{name}")
    return cases.QUERIES, cases.ORACLES
