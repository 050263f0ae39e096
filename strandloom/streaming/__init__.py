"""Incremental variants of operators on streaming DataFrames."""
