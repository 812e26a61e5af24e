"""All registered queries and their oracles under one roof."""

from __future__ import annotations

from rewardmill.plans import (
    curation_queries,
    evaluation_queries,
    form_queries,
    lifecycle_queries,
    record_queries,
    sampling_queries,
    scoring_queries,
    stream_queries,
    token_queries,
)

_MODULES = (
    curation_queries,
    scoring_queries,
    token_queries,
    sampling_queries,
    evaluation_queries,
    stream_queries,
    lifecycle_queries,
    form_queries,
    record_queries,
)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
