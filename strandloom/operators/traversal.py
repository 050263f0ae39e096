"""The unitig index and searches through the graph by frontiers.

A node in a reading direction is a signed id. Genomes are bits of an array of longs, so whether a path is still in a
genome is one AND, and one row follows a path for all genomes that share it. A frontier grows by one node a round, as a
join with the graph's steps; a path that no genome has any more does not leave the join. Every round is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.session import Pile, written

#: Steps of a graph that are broadcast to frontiers; larger ones are joined by shuffle.
MAX_STEPS = 100_000


def width(n_genomes: int) -> int:
    """Longs that hold a bit for each genome from 0 on."""
    return max((n_genomes + 63) // 64, 1)


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def without(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def some(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def bits(a: Column) -> Column:
    """The genomes of a bitmap, ascending."""
    every = F.sequence(F.lit(0), 64 * F.size(a) - 1)
    return F.filter(every, lambda g: F.get(a, (g / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), g % 64)) != 0)


def bitmaps(rows: DataFrame, keys: list[str], name: str, words: int) -> DataFrame:
    """A bitmap of genome_id for each key. Words are combined before the shuffle; a key has ``words`` of them at most."""
    word = F.floor(F.col("genome_id") / 64).cast("int")
    each = rows.groupBy(*keys, word.alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("genome_id") % 64).cast("int"))).alias("_x"))
    listed = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_x"))).alias("_m"))
    return listed.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("long"))).alias(name))


def unitig_index(nodes: DataFrame, members: DataFrame, placed: DataFrame, paths: DataFrame, k: int, n_genomes: int) -> DataFrame:
    """(node, size, n_stops, stops, entering, colours, ends): one row a node and reading direction.

    ``stops`` are the frames (from the first base) with a stop codon; ``entering`` those of the codons that end after the
    bases shared with the node before, from the first such codon. ``colours`` are the genomes that have the first or
    last k-mer, ``ends`` those of which a contig begins or ends here. Genomes are numbered from 0. nodes as of
    ``dbg.unitig_table``, members of ``dbg.unitigs``, paths of ``dbg.genome_paths``.
    """
    words = width(n_genomes)
    read = nodes.select(F.col("node_id").alias("node"), "seq").unionByName(nodes.select((-F.col("node_id")).alias("node"), S.reverse_complement(F.col("seq")).alias("seq")))
    found = read.select("node", F.length("seq").alias("size"), S.codon_positions(F.col("seq")).alias("p"))
    late = F.transform(F.filter("p", lambda x: x >= k - 3), lambda x: x - (k - 3))
    masks = found.select(F.abs("node").alias("node_id"), "node", "size", F.size("p").alias("n_stops"), S.frame_mask(F.col("p")).alias("stops"), S.frame_mask(late).alias("entering"))
    tips = members.join(nodes.select("unitig", "node_id", "size"), "unitig").where(f"offset = 0 OR offset = size - {k}").select("kmer", "node_id")
    colours = bitmaps(placed.select("kmer", "genome_id").join(tips, "kmer").select("node_id", "genome_id"), ["node_id"], "colours", words)
    ends = bitmaps(paths.where("contig_end").select(F.abs("node_id").alias("node_id"), "genome_id"), ["node_id"], "ends", words)
    none = F.array_repeat(F.lit(0).cast("long"), words)
    out = masks.join(colours, "node_id", "left").join(ends, "node_id", "left")
    return out.select("node", "size", "n_stops", "stops", "entering", F.coalesce("colours", none).alias("colours"), F.coalesce("ends", none).alias("ends"))


def stop_frequency(index: DataFrame) -> float:
    """Stop codons per codon of the graph, both strands, overlapping codons included; each base of a node counts once."""
    n, of = index.agg(F.sum("n_stops"), F.sum(F.greatest(F.col("size") - 2, F.lit(0)))).first()
    return n / of if of else 0.0


def graph_steps(index: DataFrame, paths: DataFrame, n_genomes: int, of_contigs: bool) -> DataFrame:
    """(node, next, size, stops, entering, colours, ends, met): the steps of the graph in both directions, with what the
    index has of the next node; ``met`` are that node's own colours.

    ``colours`` are the genomes that may take the step: of assemblies (``of_contigs``) those whose contigs take it, of
    reads those that have the next node.
    """
    by = Window.partitionBy("genome_id", "contig_id", "piece").orderBy("pos")
    one = paths.select("genome_id", F.col("node_id").alias("node"), F.lead("node_id").over(by).alias("next")).where("next IS NOT NULL")
    taken = one.unionByName(one.select("genome_id", (-F.col("next")).alias("node"), (-F.col("node")).alias("next")))
    there = index.select(F.col("node").alias("next"), "size", "stops", "entering", F.col("colours").alias("met"), "ends")
    if of_contigs:
        return bitmaps(taken, ["node", "next"], "colours", width(n_genomes)).join(there, "next")
    return taken.select("node", "next").distinct().join(there, "next").withColumn("colours", F.col("met"))


def turned(mask: Column, by: Column) -> Column:
    """A mask of three frames whose first frame is ``by`` of another count."""
    return F.call_function("shiftleft", mask, by).bitwiseOR(F.call_function("shiftright", mask, 3 - by)).bitwiseAND(F.lit(7))


def stop_paths(index: DataFrame, steps: DataFrame, k: int, max_length: int = 20_000, repeat: bool = False, refs: list[int] | None = None) -> DataFrame:
    """(path, genomes, open): walks from a node with a stop codon, or a contig's end, until every frame that a stop of
    the first node leaves open has met another, or a contig ends.

    All genomes at once: a walk goes on for the genomes that have all its steps. Where a contig ends inside, the walk is
    returned for that genome and goes on while a frame is open. Walks of over ``max_length`` bases end unreturned, but
    for a first step, which may be into one very long node. Without ``repeat`` no node comes twice in one direction.
    ``refs``, bitmap words of the assemblies among reads: walks begin and end in a node that an assembly has; a genome
    whose contig ends in another node goes no further. A path may come twice, for different genomes, as a genome with a
    contig's end in the first node has all frames open. Rounds are bounded by ``max_length``; each is written out.
    """
    steps = written(steps, "steps")
    if steps.count() <= MAX_STEPS:
        steps = F.broadcast(steps)
    in_refs = lambda c: some(both(c, F.array(*[F.lit(w).cast("long") for w in refs]))) if refs is not None else F.lit(True)
    heads = index.where(in_refs(F.col("colours")))
    begin = lambda genomes, frames: heads.select(F.array("node").alias("path"), "node", F.col("size").cast("long").alias("length"), frames.alias("open"), genomes.alias("genomes"))
    frontier = begin(F.col("ends"), F.lit(7)).unionByName(begin(without(F.col("colours"), F.col("ends")), F.col("stops")).where("open <> 0")).where(some(F.col("genomes")))
    found, n_nodes = Pile(index.sparkSession, "stop-paths"), 1
    while True:
        on = steps.select("node", F.col("next"), F.col("size").alias("_size"), F.col("entering").alias("_entering"), F.col("colours").alias("_colours"), F.col("ends").alias("_ends"), F.col("met").alias("_met"))
        met = frontier.join(on, "node").withColumn("genomes", both(F.col("genomes"), F.col("_colours"))).where(some(F.col("genomes")))
        if not repeat:
            met = met.where(~F.array_contains("path", F.col("next")))
        shift = ((F.col("length") - 2) % 3).cast("int")
        left = F.col("open").bitwiseAND(F.bitwise_not(turned(F.col("_entering"), shift)))
        met = met.select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("node"), (F.col("length") + F.col("_size") - (k - 1)).alias("length"), left.alias("open"), "genomes", "_ends", in_refs(F.col("_met")).alias("_known"))
        none = F.transform("genomes", lambda x: F.lit(0).cast("long"))
        long, closed = F.col("length") > max_length, F.col("open") == 0
        ready = F.when(~F.col("_known"), none).when(long, F.col("genomes") if n_nodes == 1 else none).when(closed, F.col("genomes")).otherwise(both(F.col("genomes"), F.col("_ends")))
        goes = F.when(long | closed, none).when(~F.col("_known"), without(F.col("genomes"), F.col("_ends"))).otherwise(F.col("genomes"))
        now = found.add(met.select("path", "node", "length", "open", ready.alias("ready"), goes.alias("goes")))
        frontier = now.where(some(F.col("goes"))).select("path", "node", "length", "open", F.col("goes").alias("genomes"))
        n_nodes += 1
        if frontier.isEmpty():
            return found.read(now.schema).where(some(F.col("ready"))).select("path", F.col("ready").alias("genomes"), "open")
