"""Queries by name, and their SQL counterparts."""

from __future__ import annotations

from . import pipelines, relational, retrieval, scalars, upkeep

FLAGSHIP = "topk_bm25"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name, (_query, _sql) in {**scalars.PAIRS, **relational.PAIRS, **retrieval.PAIRS, **pipelines.PAIRS, **upkeep.PAIRS}.items():
    QUERIES[_name] = _query
    if _sql:
        ORACLE_SQL[_name] = _sql
