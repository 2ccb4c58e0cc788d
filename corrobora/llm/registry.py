"""Queries and oracles of this subpackage, the pipeline included, for the driver contract."""

from __future__ import annotations

import corpus_pipeline
from corrobora.llm import queries as q


def queries() -> dict:
    return {**q.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found = dict(q.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
