"""Registry of the engine's named queries and of the SQL that checks them."""

from __future__ import annotations

from axonwave.plans import bringup_queries, check_queries, diagnosis_queries, fault_queries, file_queries, frame_queries, protocol_queries, signal_queries

GROUPS = [signal_queries, protocol_queries, diagnosis_queries, bringup_queries, frame_queries, fault_queries, file_queries, check_queries]


def queries() -> dict:
    return {name: q for g in GROUPS for name, (q, _) in g.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for g in GROUPS for name, (_, sql) in g.QUERIES.items() if sql}
