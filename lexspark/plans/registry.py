"""Queries over the driver's tables and SQL that gives the same results, by name."""

from __future__ import annotations

from lexspark.plans import extraction, relations, retrieval, scalars

_MODULES = (scalars, relations, retrieval, extraction)
QUERIES = dict(sorted((name, f) for m in _MODULES for name, f in m.QUERIES.items()))
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
