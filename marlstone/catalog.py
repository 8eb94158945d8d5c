"""All named queries of the library but those of the llm folder, and SQL that checks them."""

from __future__ import annotations

from .operators import cleaning, corpus, draws, folds, geometry, joins, measures, money, records, rules, search, sentences, splits, statistics, terms, timeline  # noqa: F401  (registers)
from .plans.dialect import oracle_sql, queries
from .streaming import rules as stream_rules, state  # noqa: F401  (registers)

__all__ = ["oracle_sql", "queries"]
