"""All registered queries and their check SQL."""

from __future__ import annotations

from curatorium.plans import q_ledger, q_progress, q_resolve, q_scoring, q_stats, q_stream, q_text

_GROUPS = (q_scoring, q_text, q_resolve, q_stats, q_ledger, q_progress, q_stream)
QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
CHECKS = {name: sql for group in _GROUPS for name, sql in group.CHECKS.items()}
