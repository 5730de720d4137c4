"""Every registered query and its SQL, by name."""

from __future__ import annotations

from corpuslens.plans import base, corpus_queries, file_queries, table_queries, text_queries  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLE)
