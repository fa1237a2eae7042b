"""Registered queries on the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import chat, courses, graph, jobs, programmes, regulations, texts, vectors

_MODULES = (graph, vectors, chat, texts, programmes, courses, regulations, jobs)


def all_queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
