"""Operators of a training-data pipeline: quality, deduplication, secrets, tokens, packing.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` list what it offers.
"""

from citeforge.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
