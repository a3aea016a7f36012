"""All queries of the library's own operators."""

from __future__ import annotations

from tessera.jobs import ast_jobs, compare_jobs, graph_jobs, html_jobs, relation_jobs, token_jobs

MODULES = [token_jobs, relation_jobs, graph_jobs, html_jobs, ast_jobs, compare_jobs]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
