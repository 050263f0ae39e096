"""Collapsing paralogs and gene families by their neighbourhoods."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.operators.components import components
from strandloom.operators.dbg import dense_ids
from strandloom.operators.traversal import bitmaps, both, some, width, without
from strandloom.session import is_written, written

CONTEXT_DEPTH = 5

#: Bytes of the nodes' genomes up to which all tasks get them.
BROADCAST = 48_000_000


def neighbourhoods(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, dist): nodes within ``depth`` steps of each seed, one join a step over all seeds at once."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y"))).distinct()
    reached = written(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("dist")).distinct(), "near")
    rim = reached
    for d in range(1, depth + 1):
        step = rim.join(both, F.col("node") == F.col("x")).select("seed", F.col("y").alias("node")).distinct().join(reached, ["seed", "node"], "left_anti")
        rim = written(step.select("seed", "node", F.lit(d).alias("dist")), "rim")
        if rim.isEmpty():
            break
        reached = written(reached.unionByName(rim), "near")
    return reached


def near_pairs(edges: DataFrame, pairs: DataFrame, parts: DataFrame | None, depth: int) -> DataFrame:
    """(a, b) of ``pairs`` that lie within ``depth`` steps of one node of degree above two, the node itself included.

    Steps are taken from the pairs that are still open, one at a time: neighbours first, then a node next to both, then
    further out. Pairs of different components never meet and leave before, if ``parts`` is given. So a dense graph, whose
    pairs meet at once, is not walked from every node. edges (u, v), parts (node, component) of these or of the graph
    before merges.
    """
    both = written(edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y"))).distinct(), "steps")
    busy = written(both.groupBy("x").agg(F.count("*").alias("d")).where("d > 2").select(F.col("x").alias("node")), "busy")
    left = pairs.select("a", "b").distinct()
    if parts is not None:
        one, two = parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        left = left.join(one, "a").join(two, "b").where("ca = cb").select("a", "b")
    left = written(left, "open")
    # next to each other, and one of them busy: that one is the node, from the first step on
    beside = left.join(both, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("a", "b")
    met = beside.join(busy.select(F.col("node").alias("a")), "a", "left_semi").unionByName(beside.join(busy.select(F.col("node").alias("b")), "b", "left_semi")).distinct()
    found = [written(met, "met")]
    for d in range(1, depth + 1):
        left = written(left.join(found[-1], ["a", "b"], "left_anti"), "open")
        if left.isEmpty():
            break
        near = neighbourhoods(edges, left.select(F.explode(F.array("a", "b")).alias("seed")).distinct(), d).join(busy, "node", "left_semi").select("seed", "node")
        near = written(near, "near-busy")
        l, r = near.select(F.col("seed").alias("a"), "node"), near.select(F.col("seed").alias("b"), "node")
        found.append(written(left.join(l, "a").join(r, ["b", "node"]).select("a", "b").distinct(), "met"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def context_similarity(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) for pairs of seeds: the sum over nodes both reach of 1 / (1 + difference of distances)."""
    left = near.select(F.col("seed").alias("a"), "node", F.col("dist").alias("da"))
    right = near.select(F.col("seed").alias("b"), "node", F.col("dist").alias("db"))
    return pairs.select("a", "b").join(left, "a").join(right, ["b", "node"]).groupBy("a", "b").agg(F.sum(1 / (1 + F.abs(F.col("da") - F.col("db")))).alias("similarity"))


def collapse_paralogs(copies: DataFrame, edges: DataFrame, depth: int = CONTEXT_DEPTH) -> DataFrame:
    """(node, merged): copies of one cluster in different genomes, matched by nearness in the graph, then by context.

    copies (cluster, node, genome). In each cluster the genome with most copies (ties: the smallest) is the reference.
    The copies of another genome are matched one to one with the reference's, so that no genome gives two copies to one
    node: pairs are taken by the length of the shortest path between them, within ``depth``, then those without one by
    the similarity of their neighbourhoods (ties: the smallest nodes). A genome's copies of one
    cluster lie in one task, row by row.
    """
    counts = copies.groupBy("cluster", "genome").agg(F.count("*").alias("n"))
    ref = counts.groupBy("cluster").agg(F.max_by("genome", F.struct("n", -F.xxhash64("genome"))).alias("_g")) if dict(copies.dtypes)["genome"] == "string" else counts.groupBy("cluster").agg(F.max_by("genome", F.struct("n", -F.col("genome"))).alias("_g"))
    flagged = copies.join(ref, "cluster")
    anchors = flagged.where("genome = _g").select("cluster", F.col("node").alias("b"))
    others = flagged.where("genome <> _g").select("cluster", "genome", F.col("node").alias("a"))
    pairs = written(others.join(anchors, "cluster").select("cluster", "genome", "a", "b"), "paralog-pairs")
    near = neighbourhoods(edges, copies.select(F.col("node").alias("seed")), depth)
    similar = context_similarity(near.where("dist > 0"), pairs)
    paths = near.select(F.col("seed").alias("a"), F.col("node").alias("b"), "dist")
    scored = pairs.join(similar, ["a", "b"], "left").join(paths, ["a", "b"], "left").select("cluster", "genome", "a", "b", F.coalesce("dist", F.lit(depth + 1)).alias("dist"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))

    def match(batches):
        key, found, used = None, set(), set()
        for batch in batches:
            nodes, merged = [], []
            for cluster, genome, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (cluster, genome) != key:
                    key, found, used = (cluster, genome), set(), set()
                if a not in found and b not in used:
                    found.add(a)
                    used.add(b)
                    nodes.append(a)
                    merged.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kinds[0]), pa.array(merged, kinds[0])], ["node", "merged"])

    kind = dict(copies.dtypes)["node"]
    kinds = [to_arrow_type(copies.schema["node"].dataType)]
    # groups lie in Arrow batches in the order their pairs are taken, instead of a Python call each
    dealt = scored.repartition(4 * copies.sparkSession.sparkContext.defaultParallelism, "cluster", "genome").sortWithinPartitions("cluster", "genome", "dist", F.col("similarity").desc(), "a", "b")
    chosen = dealt.select("cluster", "genome", "a", "b").mapInArrow(match, f"node {kind}, merged {kind}")
    return chosen.unionByName(anchors.select(F.col("b").alias("node"), F.col("b").alias("merged")))


def collapse_families(nodes: DataFrame, edges: DataFrame, similar: DataFrame, threshold: float, depths=(1, 2, 3)) -> DataFrame:
    """(node, merged): similar clusters that lie near each other and share no genome, or lie next to each other in every
    genome they share: one gene that a frame shift has split.

    nodes (node, genome), edges (u, v, and genomes if that rule is to apply), similar (a, b, identity). Within a depth, candidates are similar pairs in
    each other's neighbourhood of nodes with degree above two; their components are independent, and in each the
    pairs are taken from the most to the least similar, joining two groups if no genome is in both. Each depth works
    on what the one before made.

    Groups only gain genomes, so a pair that shares one at which it may not join never will: such pairs leave where
    they are made, before the graph is read, and what is left is walked and written. Genomes are bits. Without
    candidates, and after depths that merge nothing, no step is repeated.
    """
    kept = ["genomes"] if "genomes" in edges.columns else []
    numbered = written(dense_ids(nodes.where("genome IS NOT NULL").select("genome").distinct(), "genome", "_i").withColumn("_i", F.col("_i") - 1), "genomes")
    words = width(numbered.count())
    void = F.array_repeat(F.lit(0).cast("long"), words)
    at = nodes.join(numbered, "genome").select("node", F.col("_i").alias("genome_id"))
    current = written(nodes.select("node").distinct().withColumn("merged", F.col("node")), "families")
    named = current.withColumnsRenamed({"node": "o", "merged": "m"})
    sets = written(current.select("node").join(bitmaps(at, ["node"], "has", words), "node", "left").withColumn("has", F.coalesce("has", void)), "sets")
    few = sets.count() * (8 * words + 48) <= BROADCAST  # as many as nodes, so counted first
    similar = similar.where(F.col("identity") >= threshold).select("a", "b", "identity")
    parts, now_edges, merges = None, None, True
    for depth in depths:
        if merges:
            known = F.broadcast(sets) if few else sets
            ha, hb = known.select(F.col("node").alias("a"), F.col("has").alias("ha")), known.select(F.col("node").alias("b"), F.col("has").alias("hb"))
            met = similar.where("a <> b").join(ha, "a").join(hb, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "identity", both(F.col("ha"), F.col("hb")).alias("shared"))
            if kept:
                now_edges = written(_merged_edges(edges, named, kept), "edges")
                pairs = written(met.groupBy("a", "b").agg(F.max("identity").alias("identity"), F.first("shared").alias("shared")), "similar")
                there = now_edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "genomes").join(pairs, ["a", "b"], "left_semi")  # groups may come to share a genome that the pair does not
                beside = there.select("a", "b", F.explode("genomes").alias("genome")).join(numbered, "genome").select("a", "b", F.col("_i").alias("genome_id"))
                pairs = pairs.join(bitmaps(beside, ["a", "b"], "beside", words), ["a", "b"], "left").withColumn("beside", F.coalesce("beside", void)).where(~some(without(F.col("shared"), F.col("beside"))))
            else:
                pairs = met.where(~some(F.col("shared"))).groupBy("a", "b").agg(F.max("identity").alias("identity")).withColumn("beside", void)
            pairs = written(pairs.select("a", "b", "identity", "beside"), "open")
            if pairs.isEmpty():
                break
            if not kept:
                if now_edges is None:
                    edges = edges if is_written(edges) else written(edges, "edges")
                now_edges = written(_merged_edges(edges, named, kept), "edges")
            # components take rounds over all edges; walking from a few pairs takes less
            if parts is None and 8 * pairs.count() > now_edges.count():
                parts = written(components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))), "parts")  # merges stay within one
        close = written(pairs.join(near_pairs(now_edges, pairs, parts, depth), ["a", "b"], "left_semi"), "close")
        merges = not close.isEmpty()
        if not merges:
            continue
        links = close.groupBy("a").agg(F.collect_list(F.struct("b", "identity", "beside")).alias("links")).withColumnRenamed("a", "node")
        work = components(close.select("a", "b")).join(sets, "node").join(links, "node", "left")

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            genomes = {n: _number(g) for n, g in zip(pdf["node"], pdf["has"])}
            root = {n: n for n in genomes}

            def find(n):
                while root[n] != n:
                    n = root[n]
                return n

            todo = sorted(((-x["identity"], n, x["b"], _number(x["beside"])) for n, xs in zip(pdf["node"], pdf["links"]) if xs is not None for x in xs), key=lambda t: t[:3])
            for _, a, b, beside in todo:
                a, b = find(a), find(b)
                if a != b and not genomes[a] & genomes[b] & ~beside:
                    low, high = min(a, b), max(a, b)
                    root[high] = low
                    genomes[low] |= genomes[high]
            return pd.DataFrame({"node": list(root), "merged": [find(n) for n in root]})

        kind = dict(nodes.dtypes)["node"]
        step = written(work.groupBy("component").applyInPandas(merge, f"node {kind}, merged {kind}").where("node <> merged").select(F.col("node").alias("o2"), F.col("merged").alias("m2")), "merges")
        merges = not step.isEmpty()
        if merges:
            current = written(current.join(step, F.col("merged") == F.col("o2"), "left").select("node", F.coalesce("m2", "merged").alias("merged")), "families")
            named = current.withColumnsRenamed({"node": "o", "merged": "m"})
            has = bitmaps(at.join(named, F.col("node") == F.col("o")).select(F.col("m").alias("node"), "genome_id"), ["node"], "has", words)
            sets = written(current.select(F.col("merged").alias("node")).distinct().join(has, "node", "left").withColumn("has", F.coalesce("has", void)), "sets")
            # without edges' genomes no pair that left comes back
            similar = (similar if kept else pairs).join(named, F.col("a") == F.col("o")).select(F.col("m").alias("a"), "b", "identity").join(named, F.col("b") == F.col("o")).select("a", F.col("m").alias("b"), "identity")
    return current


def _merged_edges(edges: DataFrame, named: DataFrame, kept: list[str]) -> DataFrame:
    """Edges between groups: named (o, m) is the group of each node."""
    moved = edges.join(named, F.col("u") == F.col("o")).select(F.col("m").alias("u"), "v", *kept).join(named, F.col("v") == F.col("o")).select("u", F.col("m").alias("v"), *kept).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *kept)
    return moved.groupBy("u", "v").agg(F.array_distinct(F.flatten(F.collect_list("genomes"))).alias("genomes")) if kept else moved.distinct()


def _number(words) -> int:
    """A bitmap's longs as one number."""
    return sum((int(w) & (1 << 64) - 1) << 64 * i for i, w in enumerate(words))


def connect_orfs(orfs: DataFrame, max_distance: int = 10_000) -> DataFrame:
    """(genome, src, dst): each gene with the next one on its contig, if that begins within ``max_distance``.

    orfs (genome, contig_id, orf, start, end)."""
    from pyspark.sql import Window

    by = Window.partitionBy("genome", "contig_id").orderBy("start", "end", "orf")
    nxt = orfs.select("genome", F.col("orf").alias("src"), "end", F.lead(F.struct("orf", "start")).over(by).alias("n"))
    return nxt.where((F.col("n").isNotNull()) & (F.col("n.start") - F.col("end") <= max_distance)).select("genome", "src", F.col("n.orf").alias("dst"))
