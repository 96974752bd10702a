"""Registered queries of the library."""

from __future__ import annotations


def queries() -> dict:
    from hazardspark.plans import q_belief, q_decisions, q_functions, q_models, q_rain, q_routes, q_scoring, q_search, q_streams, q_studies, q_text, q_whole  # noqa: F401
    from hazardspark.plans.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from hazardspark.plans.registry import ORACLES

    return dict(ORACLES)
