"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from cadenza.llm import ann_search, hard_negatives, html_extraction, line_dedup, media_png, mixing, near_dedup, periodic_runs, sentencepiece_codec, token_counts, token_planes, toxicity, warc

_MODULES = (sentencepiece_codec, ann_search, line_dedup, mixing, html_extraction, token_counts, toxicity, warc, media_png, near_dedup, periodic_runs, token_planes, hard_negatives)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
