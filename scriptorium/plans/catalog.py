"""All queries outside the text-corpus subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from scriptorium.plans import audit_queries, corpus_queries, measure_queries, model_queries, score_queries

PARTS = (measure_queries, score_queries, corpus_queries, audit_queries, model_queries)


def queries() -> dict[str, Callable]:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
