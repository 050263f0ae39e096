"""Relational operators over sequence, path and gene-graph tables."""
