"""A read-only Cypher dialect, parsed here and compiled to DataFrame operations."""

from plexloom.cypher.compiler import QueryResult, compile_query, query_graph
from plexloom.cypher.parser import CypherError, parse_query

__all__ = ["CypherError", "QueryResult", "compile_query", "parse_query", "query_graph"]
