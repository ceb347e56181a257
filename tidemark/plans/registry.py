"""Queries of the event-study operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["study", "projections", "joins", "windows", "checks", "signals", "jobs", "more", "inference", "continuity", "selection", "universe", "sellers", "paths"]

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    for _key, (_query, _sql) in import_module(f"{__package__}.{_name}").QUERIES.items():
        QUERIES[_key] = _query
        if _sql:
            ORACLE[_key] = _sql
