"""Importing this module registers the queries of the corpus operators and of the corpus pipeline."""

import corpus_pipeline
from feedlake.llm import queries  # noqa: F401
from feedlake.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
