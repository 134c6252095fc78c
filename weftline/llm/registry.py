"""The queries of the llm subpackage and their SQL."""

from __future__ import annotations

from weftline.llm import conversations, exact_dedup, fim, line_dedup, media, mixing, packing, passages, pii, quality, simhash, token_files, toxicity

_MODULES = (exact_dedup, mixing, token_files, packing, media, toxicity, quality, pii, simhash, passages, fim, conversations, line_dedup)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
