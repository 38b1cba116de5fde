"""All queries of the library, with their SQL counterparts."""

from __future__ import annotations

from . import analytics, extraction, ner, tasks

PARTS = (ner, tasks, extraction, analytics)


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.oracle_sql().items()}
