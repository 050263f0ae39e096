"""Predicates of the pipeline's stages, with their usual thresholds as defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import path_string, reverse_path


def long_enough(length: Column, least: int = 90) -> Column:
    """Minimum ORF length in bases."""
    return length >= least


def good_score(score: Column, least: float = 100.0) -> Column:
    """Minimum score of an ORF or a path."""
    return score >= least


def in_genome(neighbours: DataFrame, node_colours: DataFrame) -> DataFrame:
    """(genome_id, node, next): steps to nodes that the genome itself has."""
    has = node_colours.select(F.col("node_id").alias("_n"), F.col("genome_id").alias("_g"))
    return neighbours.join(has, (F.abs("next") == F.col("_n")) & (F.col("genome_id") == F.col("_g")), "left_semi")


def ends_in_reference(ends: DataFrame, node_colours: DataFrame, genomes: DataFrame) -> DataFrame:
    """For reads: rows whose node a reference genome has."""
    refs = genomes.where("is_ref").select("genome_id")
    nodes = node_colours.join(refs, "genome_id", "left_semi").select(F.col("node_id").alias("_n")).distinct()
    return ends.join(nodes, F.abs("node") == F.col("_n"), "left_semi")


def terminal(stop_mask: Column, contig_end: Column) -> Column:
    """A node where paths may begin or end: it has a stop in frame or ends a contig."""
    return (stop_mask != 0) | contig_end


def on_path(genome_path: Column, nodes: Column) -> Column:
    """1 if a genome's path (text between commas) has the nodes in order, -1 if it has them read backwards, else 0."""
    return F.when(genome_path.contains(path_string(nodes)), 1).when(genome_path.contains(path_string(reverse_path(nodes))), -1).otherwise(0)


def short_enough(length: Column, n_nodes: Column, most: int = 20_000) -> Column:
    """Maximum path length; a path of two nodes may be longer."""
    return (length <= most) | (n_nodes <= 2)


def unvisited(path: Column, node: Column) -> Column:
    return ~F.array_contains(path, node)


def alike_in_length(a: Column, b: Column, least: float = 0.98) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b)


def pseudogene(length: Column, centroid_length: Column, refound: Column, premature_stop: Column, threshold: float = 0.8) -> Column:
    """Much shorter than the centroid; or refound with an early stop or a broken frame."""
    return (length < centroid_length * threshold) | (refound & (premature_stop | (length % 3 != 0)))


def refound(hit: Column, query: Column, identity: Column, prop_match: float = 0.2, least: float = 0.8) -> Column:
    """Enough of the query aligned, enough of it real bases, and close enough."""
    bases = F.length(F.regexp_replace(hit, "[^ACGT]", ""))
    return (F.length(hit) >= prop_match * F.length(query)) & (bases >= prop_match * F.length(query)) & (identity >= least)


def unannotated(bitscore: Column) -> Column:
    return F.coalesce(bitscore, F.lit(0.0)) == 0


def passable(avoid: Column) -> Column:
    """Whether a path may be searched: no two of its nodes in a row are to be avoided (array of booleans)."""
    return ~F.exists(F.transform(avoid, lambda a, i: a & F.coalesce(F.get(avoid, i + 1), F.lit(False))), lambda x: x)


def free_nodes(coords: DataFrame, sizes: DataFrame) -> DataFrame:
    """(genome_id, node) that no gene covers in full: where a lost gene may lie.

    coords (genome_id, node, s, e) of genes, the end exclusive; sizes (node_id, size).
    """
    full = coords.join(sizes, F.abs("node") == F.col("node_id")).where((F.col("s") == 0) & (F.col("e") == F.col("size"))).select("genome_id", F.abs("node").alias("node")).distinct()
    return coords.select("genome_id", F.abs("node").alias("node")).distinct().join(full, ["genome_id", "node"], "left_anti")
