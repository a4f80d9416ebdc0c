"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, embeddings, html_text, lm_score, simhash, substrings, token_counts, toxicity, warc
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
_MODULES = (embeddings, bpe, lm_score, simhash, decontaminate, warc, token_counts, toxicity, html_text, substrings)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
