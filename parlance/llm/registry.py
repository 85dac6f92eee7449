"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from . import collocations, decontaminate, hard_negatives, line_dedup, mixing, ngram_join, quality, secrets, simhash, substring_dedup, token_counts, toxicity, warc

_MODULES = (substring_dedup, mixing, line_dedup, quality, decontaminate, warc, ngram_join, simhash, secrets, toxicity, hard_negatives, collocations, token_counts)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
