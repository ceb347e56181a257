"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["chat", "codes", "fingerprints", "jaccard", "licenses", "lines", "mixing", "packing", "repair", "secrets", "topk", "toxicity", "warc"]

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.registered()
    ORACLE |= getattr(_module, "ORACLE", {})
