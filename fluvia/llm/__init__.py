"""Operators for training corpora and the queries that register them."""

from __future__ import annotations

from . import conversation_trie, decontamination, embedding_dedup, html_extraction, language_id, lm_scoring, merkle_manifest, minhash_dedup, mixing, quality, sharding, toxicity, url_filter

_MODULES = [sharding, mixing, url_filter, decontamination, html_extraction, lm_scoring, embedding_dedup, language_id, toxicity, minhash_dedup, conversation_trie, quality, merkle_manifest]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
