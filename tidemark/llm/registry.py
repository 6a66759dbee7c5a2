"""The queries of the corpus operators."""

from __future__ import annotations

from tidemark.llm import (
    bpe_codec,
    decontamination,
    embedding_dedup,
    exact_dedup,
    filter_audit,
    importance,
    jaccard_join,
    language_id,
    license_scan,
    lm_scores,
    packing,
    token_counts,
    toxicity,
)

MODULES = (token_counts, exact_dedup, language_id, toxicity, license_scan, jaccard_join, bpe_codec, lm_scores, packing, decontamination, embedding_dedup, importance, filter_audit)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
