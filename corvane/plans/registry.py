"""All queries of the engine by name, and their oracles."""

from __future__ import annotations

from corvane.plans import corpus, derived, evidence, planted, relational, searching, terms, text_queries, writes

QUERIES: dict = relational.QUERIES | corpus.QUERIES | evidence.QUERIES | text_queries.QUERIES | derived.QUERIES | planted.QUERIES | searching.QUERIES | terms.QUERIES | writes.QUERIES
ORACLES: dict = relational.ORACLES | corpus.ORACLES | evidence.ORACLES | text_queries.ORACLES | derived.ORACLES | planted.ORACLES | searching.ORACLES | terms.ORACLES | writes.ORACLES
FLAGSHIP = "search"
