"""Queries of the library and the SQL that gives the same rows."""

from lakeloom import queries_curation, queries_evidence, queries_graph, queries_linkage, queries_retrieval, queries_text, queries_time
from lakeloom.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_curation", "queries_evidence", "queries_graph", "queries_linkage", "queries_retrieval", "queries_text", "queries_time"]
