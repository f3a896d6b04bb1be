"""Named queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations

from tidemark.queries import lifecycle, merging, reports, requests, scans

MODULES = (scans, merging, requests, lifecycle, reports)


def all_queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
