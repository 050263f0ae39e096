"""Searches through the graph from the ends of genes: how far a genome goes on beyond them, and to which gene next.

A walk is a row with its genome, gene and side. What a node can be followed by is one row (four nodes at most), with
genomes as bits, so a round is one join on the walk's last node and no walk meets another genome's nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.traversal import MAX_STEPS, bitmaps, width
from strandloom.session import Pile, written


def holds(bitmap: Column, genome: Column) -> Column:
    """Whether a genome is in a bitmap."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (genome % 64).cast("int"))
    return F.get(bitmap, F.floor(genome / 64).cast("int")).bitwiseAND(bit) != 0


def covered_nodes(genes: DataFrame) -> DataFrame:
    """(genome_id, node_id) that a gene covers in full. genes (genome_id, path), paths as of ``alignpaths.sized``."""
    return genes.select("genome_id", F.explode("path").alias("c")).where("c.s = 0 AND c.e = c.size").select("genome_id", F.abs("c.node").alias("node_id")).distinct()


def gene_heads(genes: DataFrame) -> DataFrame:
    """(genome_id, gene, side, node, near, far, spare): the end nodes of genes, read away from them; side is 1
    downstream and -1 upstream. The gene lies from ``near`` to ``far`` of the node as read, with ``spare`` bases left.

    genes (genome_id, gene, path)."""
    last, first = F.element_at("path", -1), F.get("path", 0)
    down = F.struct(F.lit(1).alias("side"), last["node"].alias("node"), last["s"].alias("near"), last["e"].alias("far"), last["size"].alias("size"))
    up = F.struct(F.lit(-1).alias("side"), (-first["node"]).alias("node"), (first["size"] - first["e"]).alias("near"), (first["size"] - first["s"]).alias("far"), first["size"].alias("size"))
    each = genes.where(F.size("path") > 0).select("genome_id", "gene", F.explode(F.array(down, up)).alias("h"))
    return each.select("genome_id", "gene", "h.side", "h.node", "h.near", "h.far", (F.col("h.size") - F.col("h.far")).cast("long").alias("spare"))


def followers(steps: DataFrame, marked: DataFrame, n_genomes: int, least_genomes: int = 1) -> DataFrame:
    """(node, outs): for each node what can follow it, with the genomes that may take the step, those of which a contig
    ends in the next node, and those that have it ``marked`` (genome_id, node_id).

    steps as of ``traversal.graph_steps``; only nodes that ``least_genomes`` have are entered (two for reads).
    """
    bits = bitmaps(marked, ["node_id"], "marked", width(n_genomes)).withColumnRenamed("node_id", "_id")
    known = F.aggregate("met", F.lit(0), lambda a, x: a + F.bit_count(x)) >= least_genomes
    each = steps.where(known).join(bits, F.abs("next") == F.col("_id"), "left")
    none = F.array_repeat(F.lit(0).cast("long"), width(n_genomes))
    out = F.struct("next", F.col("size").cast("long").alias("size"), "colours", "ends", F.coalesce("marked", none).alias("marked"))
    return each.groupBy("node").agg(F.array_sort(F.collect_set(out)).alias("outs"))


def _known(table: DataFrame) -> DataFrame:
    """A table of followers, written; broadcast while small."""
    table = written(table, "followers")
    return F.broadcast(table) if table.count() <= MAX_STEPS else table


def _may(repeat: bool):
    """The followers that a walk's genome can take."""
    return F.filter(F.coalesce("outs", F.array()), lambda x: holds(x["colours"], F.col("genome_id")) & (F.lit(repeat) | ~F.array_contains("path", x["next"])))


def extend(genes: DataFrame, steps: DataFrame, k: int, n_genomes: int, radius: int = 5000, covered: DataFrame | None = None, repeat: bool = False, least_genomes: int = 1) -> DataFrame:
    """(genome_id, gene, side, path, length, why): walks from both ends of genes over what their genome has, until they
    are ``radius`` bases long.

    ``path`` begins with the gene's end node read outward (upstream nodes are read backwards), ``length`` counts the
    bases beyond the gene. A walk ends by ``why``: ``radius``; ``end``, in a node in which a contig of the genome ends
    (other copies of the node may go on, so the walk does as well); ``dead``, no node follows; or ``blocked``. Nodes that
    genes cover in full (``covered``, those of ``genes`` by default) may be passed, but not two in a row; a walk that can
    only go on so is blocked before the second. Without ``repeat`` no node comes twice in one direction. Every round
    adds a base at least, so ``radius`` bounds them; each is written out. A gene without nodes has no walks.
    """
    covered = covered_nodes(genes) if covered is None else covered
    outs = _known(followers(steps, covered, n_genomes, least_genomes))
    heads = gene_heads(genes).select("genome_id", "gene", "side", F.array("node").alias("path"), "node", F.col("spare").alias("length"), F.lit(False).alias("after"))
    pile = Pile(genes.sparkSession, "outward")
    frontier = pile.add(heads.withColumn("why", F.when(F.col("length") >= radius, "radius")).withColumn("goes", F.col("length") < radius)).where("goes")
    while not frontier.isEmpty():
        may = frontier.withColumnRenamed("why", "told").join(outs, "node", "left").withColumn("may", _may(repeat))
        may = may.withColumn("on", F.filter("may", lambda x: ~(F.col("after") & holds(x["marked"], F.col("genome_id")))))
        each = may.select("genome_id", "gene", "side", "path", "node", "length", "after", "told", (F.size("may") > 0).alias("some"), F.explode_outer("on").alias("x"))
        far, stays = F.col("length") + F.col("x.size") - (k - 1), F.col("x").isNull()
        why = F.when(stays, F.when(F.col("some"), "blocked").otherwise("dead")).when(far >= radius, "radius").when(holds(F.col("x.ends"), F.col("genome_id")), "end")
        now = each.where(~stays | F.col("told").isNull()).select(
            "genome_id", "gene", "side",
            F.when(stays, F.col("path")).otherwise(F.array_append("path", F.col("x.next"))).alias("path"),
            F.coalesce("x.next", "node").alias("node"),
            F.when(stays, F.col("length")).otherwise(far).alias("length"),
            F.when(stays, F.col("after")).otherwise(holds(F.col("x.marked"), F.col("genome_id"))).alias("after"),
            why.alias("why"), (~stays & (far < radius)).alias("goes"),
        )
        frontier = pile.add(now).where("goes")
    return pile.read(frontier.schema).where("why IS NOT NULL").select("genome_id", "gene", "side", "path", "length", "why")


def farthest(walks: DataFrame, blocked: bool = False) -> DataFrame:
    """The longest walk of each gene and side, ties by the smaller path; blocked ones only if asked for, as what lies
    there is taken."""
    some = walks if blocked else walks.where("why <> 'blocked'")
    least = F.transform("path", lambda x: -x)
    best = some.groupBy("genome_id", "gene", "side").agg(F.max(F.struct("length", least.alias("p"), "why")).alias("w"))
    return best.select("genome_id", "gene", "side", F.transform("w.p", lambda x: -x).alias("path"), F.col("w.length").alias("length"), F.col("w.why").alias("why"))


def around(genes: DataFrame, walks: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(genome_id, gene, path, seq): a gene's nodes with its farthest walks at both sides, and what they spell.

    walks as of ``farthest``; a side without one ends with the gene's own node. nodes (node, seq) of both directions.
    """
    side = lambda s, name: walks.where(F.col("side") == s).select("genome_id", "gene", F.col("path").alias(name))
    own = F.transform("path", lambda c: c["node"])
    before = F.transform(F.reverse(F.slice("_up", 2, F.greatest(F.size("_up") - 1, F.lit(0)))), lambda x: -x)
    after = F.slice("_down", 2, F.greatest(F.size("_down") - 1, F.lit(0)))
    none = F.array().cast("array<long>")
    whole = F.concat(F.coalesce(before, none), own.cast("array<long>"), F.coalesce(after, none))
    paths = written(genes.join(side(-1, "_up"), ["genome_id", "gene"], "left").join(side(1, "_down"), ["genome_id", "gene"], "left").select("genome_id", "gene", whole.alias("path")), "around")
    read = paths.select("genome_id", "gene", F.posexplode("path").alias("at", "node")).join(nodes.select("node", "seq"), "node")
    parts = read.groupBy("genome_id", "gene").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("at") == 0, F.col("seq")).otherwise(F.substr("seq", F.lit(k))).alias("x")))).alias("p"))
    return paths.join(parts, ["genome_id", "gene"]).select("genome_id", "gene", "path", F.array_join(F.transform("p", lambda v: v["x"]), "").alias("seq"))


def next_genes(genes: DataFrame, steps: DataFrame, k: int, n_genomes: int, most: int = 10_000, repeat: bool = False, least_genomes: int = 1, of: DataFrame | None = None) -> DataFrame:
    """(genome_id, gene, side, other, gap): for each gene and side the genes that come next within ``most`` bases.

    On the gene's own end node that is the one that begins next there. Else every walk goes on to the first node in which
    a gene of the genome begins or ends, and takes the first gene there, so there are several where the graph branches.
    Genes on a node are in the order of where they begin, then end, on it as read, then by id. ``gap`` is the bases
    between, negative if they overlap; a walk that comes back to its own gene only has none. ``of`` (genome_id, gene):
    those to search from (all by default). Each round is written out.
    """
    ends = written(gene_heads(genes), "gene-ends")
    # how a walk that comes from elsewhere reads the node: in the other direction the gene lies mirrored
    size = F.col("far") + F.col("spare")
    back = ends.select("genome_id", "gene", (-F.col("node")).alias("node"), (size - F.col("far")).alias("near"), (size - F.col("near")).alias("far"))
    lie = written(ends.select("genome_id", "gene", "node", F.col("near").cast("long").alias("near"), F.col("far").cast("long").alias("far")).unionByName(back.withColumns({c: F.col(c).cast("long") for c in ("near", "far")})).distinct(), "gene-places")
    order = Window.partitionBy("genome_id", "node").orderBy("near", "far", "gene")
    # a gene is on a node twice at most, so one of three places is another's
    two = F.array(F.lead(F.struct("near", "gene"), 1).over(order), F.lead(F.struct("near", "gene"), 2).over(order))
    beside = lie.withColumn("next", F.get(F.filter(two, lambda x: x.isNotNull() & (x["gene"] != F.col("gene"))), F.lit(0)))
    firsts = lie.withColumn("_n", F.row_number().over(order)).where("_n <= 3").groupBy("genome_id", "node").agg(F.array_sort(F.collect_list(F.struct("near", "far", "gene"))).alias("first"))
    wanted = ends if of is None else ends.join(of.select("genome_id", "gene").distinct(), ["genome_id", "gene"], "left_semi")
    heads = written(wanted.join(beside.select("genome_id", "gene", "node", "near", "far", "next"), ["genome_id", "gene", "node", "near", "far"]), "gene-heads")
    direct = heads.where("next IS NOT NULL").select("genome_id", "gene", "side", F.col("next.gene").alias("other"), (F.col("next.near") - F.col("far")).cast("long").alias("gap"))

    outs = _known(followers(steps, lie.select("genome_id", F.abs("node").alias("node_id")).distinct(), n_genomes, least_genomes))
    start = heads.where("next IS NULL").select("genome_id", "gene", "side", F.array("node").alias("path"), "node", F.col("spare").alias("length"), F.lit(False).alias("met"))
    pile = Pile(genes.sparkSession, "next-genes")
    frontier = pile.add(start)
    while not frontier.isEmpty():
        on = frontier.where(F.col("length") - (k - 1) <= most).join(outs, "node").select("genome_id", "gene", "side", "path", "length", F.explode(_may(repeat)).alias("x"))
        met = holds(F.col("x.marked"), F.col("genome_id"))
        # a walk that has met a gene keeps the length up to the node where it did
        grown = F.when(met, F.col("length")).otherwise(F.col("length") + F.col("x.size") - (k - 1))
        now = on.select("genome_id", "gene", "side", F.array_append("path", F.col("x.next")).alias("path"), F.col("x.next").alias("node"), grown.alias("length"), met.alias("met"))
        frontier = pile.add(now).where("NOT met")
    came = pile.read(start.schema).where("met").join(firsts, ["genome_id", "node"])
    first = F.get(F.filter("first", lambda x: x["gene"] != F.col("gene")), F.lit(0))
    found = came.withColumn("f", first).where("f IS NOT NULL").select("genome_id", "gene", "side", F.col("f.gene").alias("other"), (F.col("length") - (k - 1) + F.col("f.near")).cast("long").alias("gap"))
    every = direct.unionByName(found).where(F.col("gap") <= most)
    return every.groupBy("genome_id", "gene", "side", "other").agg(F.min("gap").alias("gap"))


def connections(nexts: DataFrame) -> DataFrame:
    """(genome_id, a, b, gap): each connected pair of genes once, the smaller id first, with its smallest gap."""
    return nexts.groupBy("genome_id", F.least("gene", "other").alias("a"), F.greatest("gene", "other").alias("b")).agg(F.min("gap").alias("gap"))
