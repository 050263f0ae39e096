"""Choosing start codons, scoring ORFs, removing copies."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import reverse_complement

# Weights of the ORF score.
GENE_WEIGHT, TIS_WEIGHT, THRESHOLD = 0.9746869839852076, 0.25380288790532707, 0.47256101519707244
START_WEIGHT = {"ATG": 0.84249804151264, "GTG": 0.7083689705744909, "TTG": 0.7512400826652517}
MAX_SCORE = GENE_WEIGHT + TIS_WEIGHT + START_WEIGHT["ATG"]


class Scorer(Protocol):
    """A model of coding sequences or start sites: sequences in, probabilities out, one batch at a time."""

    def __call__(self, sequences: pd.Series) -> pd.Series: ...


def score_distinct(df: DataFrame, column: str, scorer: Scorer, name: str) -> DataFrame:
    """Score each distinct sequence once, in Arrow batches, and join the scores back."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return scorer(s)

    scored = df.select(column).distinct().select(F.col(column).alias("_s"), run(column).alias(name))
    return df.join(scored, F.col(column) == F.col("_s"), "left").drop("_s")


def tis_window(seq: Column, start: Column, width: int = 16) -> Column:
    """The bases around a start codon, reversed: ``width`` before it and ``width`` after; null without enough before."""
    whole = F.substr(seq, start - width + 1, F.lit(2 * width + 3))
    return F.when(start >= width, F.reverse(F.concat(F.substr(whole, F.lit(1), F.lit(width)), F.substr(whole, F.lit(width + 4), F.lit(width)))))


def start_windows(contigs: DataFrame, orfs: DataFrame, keys: list[str], seq: str, width: int = 16) -> DataFrame:
    """(keys, strand, start, end, window): ``tis_window`` of the starts of ORFs (keys, strand, start, end on the forward
    strand), upstream bases of the contig included.

    A contig meets all its ORFs in one row, so its sequence is not copied for each; it is cut as bytes, which need no
    counting from its beginning.
    """
    listed = orfs.groupBy(*keys).agg(F.collect_set(F.struct("strand", "start", "end")).alias("_o"))
    raw = F.col(seq).cast("binary")

    def window(o: Column) -> Column:
        forward = o["strand"] > 0
        first = F.when(forward, o["start"] - width).otherwise(o["end"] - 3 - width)
        around = F.substr(raw, F.greatest(first, F.lit(0)) + 1, F.lit(2 * width + 3)).cast("string")
        whole = (first >= 0) & (first + 2 * width + 3 <= F.length(seq))
        return F.when(whole, tis_window(F.when(forward, around).otherwise(reverse_complement(around)), F.lit(width), width))

    each = contigs.join(listed, keys).select(*keys, F.explode(F.transform("_o", lambda o: F.struct(o["strand"].alias("strand"), o["start"].alias("start"), o["end"].alias("end"), window(o).alias("window")))).alias("_x"))
    return each.select(*keys, "_x.*")


def orf_score(gene_prob: Column, tis_prob: Column, start_codon: Column, length: Column) -> Column:
    """(weighted gene probability + weighted start site + start codon - threshold) * length."""
    start = F.lit(START_WEIGHT["ATG"])  # as are unknown starts
    for codon, w in START_WEIGHT.items():
        start = F.when(start_codon == codon, w).otherwise(start)
    return (gene_prob * GENE_WEIGHT + tis_prob * TIS_WEIGHT + start - THRESHOLD * MAX_SCORE) * length


def length_decay(best: Column, length: Column, stop_freq: Column) -> Column:
    """Probability of meeting no stop in the codons by which the best start's ORF is longer."""
    return F.pow(1 - stop_freq, F.floor(best / 3) - F.floor(length / 3))


def mean_logit(probs: Column) -> Column:
    """The mean of probabilities on the logit scale."""
    logit = F.aggregate(probs, F.lit(0.0), lambda a, p: a + F.ln(p / (1 - p)))
    return 1 / (1 + F.exp(-logit / F.size(probs)))


def choose_starts(starts: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """One start per (id, frame, stop): starts (id, frame, stop, start, len, tis, site_genomes, stop_freq).

    Starts are taken by length; a shorter one replaces the best so far if it wins two of three votes: found in more
    genomes at its site, a better start-site probability, chosen more often at its site. How often a site is chosen
    comes from a first pass without that vote, so the result does not depend on the order of genomes. A start stops
    being a rival when it is so much shorter that meeting no stop in between by chance is less likely than ``tolerance``.
    """
    first = _fold(starts.withColumn("chosen", F.lit(0).cast("long")), tolerance)
    if "site" not in starts.columns:
        return first
    picked = first.join(starts.select("id", "frame", "stop", "start", "site"), ["id", "frame", "stop", "start"]).groupBy("site").agg(F.count("*").alias("chosen"))
    return _fold(starts.join(picked, "site", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)).cast("long")), tolerance)


def _fold(starts: DataFrame, tolerance: float) -> DataFrame:
    listed = starts.groupBy("id", "frame", "stop").agg(F.sort_array(F.collect_list(F.struct("len", "start", "tis", "site_genomes", "chosen", "stop_freq")), asc=False).alias("s"))

    def vote(best, x):
        votes = (x["site_genomes"] > best["site_genomes"]).cast("int") + (x["tis"] > best["tis"]).cast("int") + (x["chosen"] > best["chosen"]).cast("int")
        rival = length_decay(best["len"], x["len"], x["stop_freq"]) >= tolerance
        return F.when(rival & (votes >= 2), x).otherwise(best)

    best = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.get("s", 0), vote)
    return listed.select("id", "frame", "stop", best.alias("b")).select("id", "frame", "stop", "b.start", "b.len")


def without_copies(orfs: DataFrame, genome: str, seq: str, n_nodes: str) -> DataFrame:
    """One ORF per genome and sequence: the one on most nodes, then of the smallest id; (genome, seq, orf_id, nodes)."""
    rest = [c for c in orfs.columns if c not in (genome, seq)]
    return orfs.groupBy(genome, seq).agg(F.max_by(F.struct(*rest), F.struct(n_nodes, -F.col("orf_id"))).alias("_r")).select(genome, seq, "_r.*")


def strand_votes(orfs: DataFrame, consensus: DataFrame) -> DataFrame:
    """(genome_id, orf_id, forward): whether most of an ORF's nodes are read as the consensus reads them.

    orfs (genome_id, orf_id, nodes), consensus (node, forward)."""
    each = orfs.select("genome_id", "orf_id", F.explode("nodes").alias("n"))
    agree = each.join(consensus, F.abs("n") == F.col("node")).withColumn("v", F.when((F.col("n") > 0) == F.col("forward"), 1).otherwise(-1))
    return agree.groupBy("genome_id", "orf_id").agg((F.sum("v") >= 0).alias("forward"))


def strand_consensus(orfs: DataFrame) -> DataFrame:
    """(node, forward): orientations under which ORFs that share nodes read them alike.

    Each node is two, one a strand; nodes of an ORF in the same reading are joined, and so are their opposites. A
    component and its mirror image are then the two choices, and the one with the smallest node read forward is taken.
    """
    from strandloom.operators.components import components

    first = orfs.select(F.explode(F.transform(F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))), lambda n: F.struct(F.get("nodes", 0).alias("x"), n.alias("y")))).alias("p")).select("p.x", "p.y").distinct()
    code = lambda c: F.when(c > 0, c * 2).otherwise(-c * 2 + 1).cast("long")
    edges = first.select(code(F.col("x")).alias("a"), code(F.col("y")).alias("b")).unionByName(first.select(code(-F.col("x")).alias("a"), code(-F.col("y")).alias("b")))
    comp = components(edges)
    nodes = orfs.select(F.explode(F.transform("nodes", F.abs)).alias("node")).distinct()
    two = nodes.join(comp.select((F.col("node") / 2).cast("long").alias("n"), (F.col("node") % 2 == 0).alias("forward"), "component"), F.col("node") == F.col("n"), "left")
    least = two.groupBy("node").agg(F.min_by("forward", F.struct("component", ~F.col("forward"))).alias("forward"))
    return least.select("node", F.coalesce("forward", F.lit(True)).alias("forward"))
