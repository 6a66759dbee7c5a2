"""Every query of the library, by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from tidemark.plans import evaluation, files, logs, panel, runs, serving, texts

CATALOGS = (panel.CATALOG, evaluation.CATALOG, texts.CATALOG, serving.CATALOG, runs.CATALOG, logs.CATALOG, files.CATALOG)


def queries() -> dict:
    return {name: query for catalog in CATALOGS for name, query in catalog.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for catalog in CATALOGS for name, sql in catalog.sql.items()}
