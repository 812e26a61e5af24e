"""Queries and oracles of this subpackage."""

from __future__ import annotations

from rewardmill.llm import chat_queries, dedup_queries, fingerprint_queries, language_queries, license_queries, mixing_queries, quality_queries, repair_queries, search_queries, spelling_queries, token_queries, vector_queries

_MODULES = (chat_queries, token_queries, search_queries, dedup_queries, fingerprint_queries, language_queries, quality_queries, mixing_queries, license_queries, repair_queries, spelling_queries, vector_queries)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
