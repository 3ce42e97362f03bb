"""Queries of the source-corpus engine, and SQL that gives the same rows."""

from __future__ import annotations

from . import corpus, more, queries, relations, rendered, tool_logs

QUERIES = queries.QUERIES | corpus.QUERIES | more.QUERIES | relations.QUERIES | rendered.QUERIES | tool_logs.QUERIES
ORACLE = queries.ORACLE | corpus.ORACLE | more.ORACLE | relations.ORACLE | rendered.ORACLE | tool_logs.ORACLE
FLAGSHIP = "rule_groups"
__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
