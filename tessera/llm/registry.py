"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import chat, conversation_repair, decontaminate, jaccard_join, language_id, mixture, page_templates, pii, spelling, suffix_dedup, superkmer_dedup, syncmers, warc

MODULES = [decontaminate, pii, suffix_dedup, syncmers, language_id, superkmer_dedup, warc, chat, jaccard_join, mixture, spelling, conversation_repair, page_templates]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
