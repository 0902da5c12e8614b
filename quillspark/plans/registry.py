"""All registered queries of the search engine, and the SQL they are checked against."""

from __future__ import annotations

from . import documents, lexical, maintenance, searches, vectors

_MODULES = (lexical, vectors, maintenance, documents, searches)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
