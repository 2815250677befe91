"""Queries over the driver's tables, by name, with SQL that gives the same rows."""

from __future__ import annotations

from sparkloom.queries import code, extra, files, graphs, guides, history, more, search

MODULES = (files, graphs, history, search, more, extra, code, guides)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
