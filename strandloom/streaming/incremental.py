"""Genomes that arrive one after another: running counts on a stream of contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import kmers, reverse_complement


def running_kmer_counts(contigs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): occurrences of canonical k-mers so far, from a streaming DataFrame with ``seq``; write with output
    mode ``update``. State is a row a k-mer and grows with the distinct k-mers, not with the stream."""
    each = contigs.select(F.explode(kmers(F.upper("seq"), k)).alias("x")).where(~F.col("x").rlike("[^ACGT]"))
    return each.select(F.least("x", reverse_complement(F.col("x"))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def running_gene_counts(calls: DataFrame) -> DataFrame:
    """(gene, n_genomes): genomes per gene so far, from a stream of (genome, gene) in which a pair may come again.

    The repeated pairs are dropped by state on the pair, then counted.
    """
    return calls.dropDuplicates(["genome", "gene"]).groupBy("gene").agg(F.count("*").alias("n_genomes"))
