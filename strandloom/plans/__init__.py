"""Registered queries with the SQL that states the same result."""

from strandloom.plans import graph_queries, io_queries, matrix_queries, model_queries, more_queries, orf_queries, path_queries, sequence_queries, traversal_queries
from strandloom.plans.registry import ORACLES, QUERIES

__all__ = ["all_queries", "all_oracles", "graph_queries", "io_queries", "matrix_queries", "model_queries", "more_queries", "orf_queries", "path_queries", "sequence_queries", "traversal_queries"]


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
