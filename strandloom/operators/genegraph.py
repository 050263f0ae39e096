"""The gene graph: clusters as nodes, adjacency in genomes as edges, and its clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import components
from strandloom.operators.traversal import bitmaps, bits, some, width, without
from strandloom.session import Pile, discard, is_written, written


#: Words of 64 genomes up to which an edge's genomes are gathered as bits.
EDGE_WORDS = 8


def edges_of(adjacency: DataFrame, genomes: DataFrame | None = None) -> DataFrame:
    """(u, v, n_genomes, genomes), u < v, from (genome, src, dst): unordered cluster pairs with their support. A null genome
    is none.

    With ``genomes``, a column of all genomes, these are bits: a task has a row for each pair, not for each pair and
    genome, and nothing is collected. Over ``EDGE_WORDS`` words of them, or without, distinct rows are collected instead.
    """
    pairs = adjacency.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "genome")
    names = [] if genomes is None else [r[0] for r in genomes.dropna().distinct().limit(64 * EDGE_WORDS + 1).collect()]  # so many at most
    if genomes is None or len(names) > 64 * EDGE_WORDS:
        return pairs.distinct().groupBy("u", "v").agg(F.count("genome").alias("n_genomes"), F.sort_array(F.collect_set("genome")).alias("genomes"))
    names.sort(key=lambda g: g.encode() if isinstance(g, str) else g)
    words = [f"_w{w}" for w in range(width(len(names)))]
    numbered = adjacency.sparkSession.createDataFrame(list(enumerate(names)), f"_i int, _g {genomes.dtypes[0][1]}")
    bit = lambda w: F.when(F.floor(F.col("_i") / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i") % 64)).otherwise(F.lit(0).cast("long"))
    met = pairs.join(F.broadcast(numbered), F.col("genome") == F.col("_g"), "left")
    each = met.groupBy("u", "v").agg(*[F.coalesce(F.bit_or(bit(i)), F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)])
    listed = F.array(*[F.lit(g) for g in names]) if names else F.array().cast(f"array<{genomes.dtypes[0][1]}>")
    n = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("long")
    return each.select("u", "v", n.alias("n_genomes"), F.transform(bits(F.array(*words)), lambda g: F.get(listed, g)).alias("genomes"))


def cluster_steps(steps: DataFrame, members: DataFrame) -> DataFrame:
    """(genome, src, dst) of clusters: steps (genome, src, dst) between ORFs, members (genome, orf, cluster). Steps to an
    ORF that is in no cluster are lost."""
    one = members.select("genome", F.col("orf").alias("src"), F.col("cluster").alias("_s"))
    two = members.select("genome", F.col("orf").alias("dst"), F.col("cluster").alias("_d"))
    return steps.join(one, ["genome", "src"]).join(two, ["genome", "dst"]).select("genome", F.col("_s").alias("src"), F.col("_d").alias("dst"))


def surviving(members: DataFrame, present: DataFrame) -> DataFrame:
    """members (genome, orf, cluster) whose ORF is among ``present`` (genome, orf)."""
    return members.join(present.select("genome", "orf"), ["genome", "orf"], "left_semi")


def structural_rtab(variants: DataFrame, edges: DataFrame, genomes: list[str]) -> DataFrame:
    """(node, left, right) and a column for each genome: 1 if it has both edges of the variant, else 0.

    variants (node, left, right), edges (u, v, genomes)."""
    at = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    e = edges.select(F.struct("u", "v").alias("e"), "genomes")
    one, two = e.select(F.col("e").alias("e1"), F.col("genomes").alias("g1")), e.select(F.col("e").alias("e2"), F.col("genomes").alias("g2"))
    keyed = variants.select("node", "left", "right", at(F.col("node"), F.col("left")).alias("e1"), at(F.col("node"), F.col("right")).alias("e2"))
    both = keyed.join(one, "e1").join(two, "e2").withColumn("g", F.array_intersect("g1", "g2"))
    return both.select("node", "left", "right", *[F.array_contains("g", g).cast("int").alias(g) for g in genomes])


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); has_end is a degree below two."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).withColumn("has_end", F.col("degree") < 2)


def paralogs(members: DataFrame) -> DataFrame:
    """Clusters with a genome more than once, from (cluster, genome, orf)."""
    return members.groupBy("cluster", "genome").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max("n").alias("copies")).where("copies > 1")


def split_paralogs(members: DataFrame) -> DataFrame:
    """(node, cluster, genome, orf): paralogous clusters have a node per member, others one."""
    bad = paralogs(members).select(F.col("cluster").alias("c2"))
    flagged = members.join(bad, F.col("cluster") == F.col("c2"), "left")
    return flagged.select(F.when(F.col("c2").isNotNull(), F.xxhash64("cluster", "genome", "orf")).otherwise(F.xxhash64("cluster")).alias("node"), "cluster", "genome", "orf")


def structural_variants(edges: DataFrame, min_support: int = 2, min_degree: int = 3) -> DataFrame:
    """(node, left, right, n_genomes), left < right: pairs of edges at a branching node that enough genomes share.

    Edges of too few genomes cannot be part of one and leave first. Genomes are bits: the edges of a node are joined
    with each other and a pair is kept or not where it is made, so what is shuffled are edges. A hub whose edges share few
    genomes has them paired within each genome instead, where it has a few neighbours. A hub's edges are dealt into
    blocks, so that its pairs are made in many tasks. ``edges`` is read several times, so it should be a written table.
    """
    from strandloom.operators.dbg import dense_ids

    swapped = lambda df: df.unionByName(df.select(F.col("node").alias("nbr"), F.col("nbr").alias("node"), *[c for c in df.columns if c not in ("node", "nbr")]))
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    branching = ends.groupBy("node").agg(F.count("*").alias("d")).where(F.col("d") >= min_degree).select("node")
    each = edges.where(F.size("genomes") >= min_support).select(F.col("u").alias("node"), F.col("v").alias("nbr"), F.explode("genomes").alias("genome"))
    numbered = written(dense_ids(each.select("genome").distinct(), "genome", "_i"), "genomes")
    words = width(numbered.count())
    each = swapped(each.join(numbered, "genome").select("node", "nbr", (F.col("_i") - 1).alias("genome_id")))
    each = written(each.join(branching, "node", "left_semi"), "sides")
    able = bitmaps(each, ["node", "nbr"], "g", words)
    within = each.groupBy("node", "genome_id").agg(F.count("*").alias("n")).groupBy("node").agg(F.sum(F.col("n") * F.col("n")).alias("within"))
    loads = able.groupBy("node").agg(F.count("*").alias("d")).join(within, "node")
    loads = written(loads.where("d > 1").select("node", (F.col("d") * F.col("d") > 16 * F.col("within")).alias("sparse"), F.ceil(F.col("d") / 2000).cast("int").alias("blocks")), "loads")
    dense = able.join(loads.where("NOT sparse"), "node")
    left = dense.select("node", F.col("nbr").alias("left"), "g", F.pmod(F.hash("nbr"), F.col("blocks")).alias("block"))
    right = dense.select(F.col("node").alias("n2"), F.col("nbr").alias("right"), F.col("g").alias("g2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b2"))
    shared = sum((F.bit_count(F.get("g", F.lit(w)).bitwiseAND(F.get("g2", F.lit(w)))) for w in range(words)), F.lit(0))
    met = left.join(right, (F.col("node") == F.col("n2")) & (F.col("block") == F.col("b2")) & (F.col("left") < F.col("right")) & (shared >= min_support))
    listed = each.join(loads.where("sparse"), "node", "left_semi").groupBy("node", "genome_id").agg(F.sort_array(F.collect_list("nbr")).alias("n")).where(F.size("n") > 1)
    pairs = listed.select("node", F.col("n"), F.posexplode("n").alias("i", "left")).select("node", "left", F.explode(F.slice("n", F.col("i") + 2, F.size("n") - F.col("i") - 1)).alias("right"))
    few = pairs.groupBy("node", "left", "right").agg(F.count("*").cast("int").alias("n_genomes")).where(F.col("n_genomes") >= min_support)
    return met.select("node", "left", "right", shared.alias("n_genomes")).unionByName(few)


def trim_ends(nodes: DataFrame, edges: DataFrame, min_support: int, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Drop nodes (node, size) of degree at most one and size below the support, up to ``rounds`` times.

    Degrees are counted once. A round takes the edges of the nodes that go from their neighbours' degrees, so it writes what
    changes and not the edges; these are read in each round and should be a written table, or are written here. All that
    went leaves the edges in the end.
    """
    edges = edges if is_written(edges) else written(edges, "edges")
    light = nodes.where(F.col("size") < min_support).select("node")
    # only light nodes can go; their degrees are all that rounds change
    state = written(light.join(degrees(edges).select("node", "degree"), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")), "light")
    pile, weak = Pile(edges.sparkSession, "weak"), None
    for _ in range(rounds):
        weak = pile.add(state.where("degree <= 1").select("node"))
        if weak.isEmpty():
            break
        lost = edges.join(weak.withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node")).unionByName(edges.join(weak.withColumnRenamed("node", "v"), "v", "left_semi").select(F.col("u").alias("node")))
        less = lost.groupBy("node").agg(F.count("*").alias("less"))
        rest = state.where("degree > 1").join(less, "node", "left").select("node", (F.col("degree") - F.coalesce("less", F.lit(0))).alias("degree"))
        rest = written(rest, "light")
        discard(state)
        state = rest
    if weak is None:
        return nodes, edges
    gone = pile.read(weak.schema).select("node")
    kept = edges.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti")
    return nodes.join(gone, "node", "left_anti"), kept.select(edges.columns)


def clean_edges(nodes: DataFrame, edges: DataFrame, threshold: int, share: float = 0.05) -> DataFrame:
    """Drop edges that misassemblies make: of too little support next to a contig end, or of less than ``share`` of
    the smaller node and below the threshold. nodes (node, size, has_end)."""
    u = nodes.select(F.col("node").alias("u"), F.col("size").alias("su"), F.col("has_end").alias("eu"))
    v = nodes.select(F.col("node").alias("v"), F.col("size").alias("sv"), F.col("has_end").alias("ev"))
    joined = edges.join(u, "u").join(v, "v")
    weak = F.col("n_genomes") < threshold
    bad = ((F.col("eu") | F.col("ev")) & weak) | ((F.col("n_genomes") < share * F.least("su", "sv")) & weak)
    return joined.where(~bad).select(edges.columns)


def merge_paralogs(centroids: DataFrame) -> DataFrame:
    """(node, merged): paralog nodes that share a centroid, directly or through others, as the least of them.

    centroids (node: long, centroid): every node hooks to the least node of each of its centroids, so a centroid of
    many nodes costs a row per node and no pairs.
    """
    first = centroids.groupBy("centroid").agg(F.min("node").alias("b"))
    edges = centroids.join(first, "centroid").select(F.col("node").alias("a"), "b")
    comp = components(edges)
    return centroids.select("node").distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("merged"))


def merge_attributes(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """Attributes of merged nodes: members, lengths, best hit, flags, and the new centroid (longest, then smallest).

    nodes (node, genome, orf, seq, annotation, bitscore, has_end); merged (node, merged).
    """
    m = nodes.join(merged, "node")
    centroid = F.min_by(F.struct("genome", "orf"), F.struct(-F.length("seq"), F.md5("seq"), "genome", "orf"))
    return m.groupBy("merged").agg(
        F.count_distinct("genome").alias("size"),
        F.sort_array(F.collect_set(F.struct("genome", "orf"))).alias("members"),
        centroid.alias("centroid"),
        F.max("bitscore").alias("bitscore"),
        F.max_by("annotation", F.struct("bitscore", "annotation")).alias("annotation"),
        F.array_join(F.sort_array(F.collect_set("annotation")), ";").alias("description"),
        F.bool_or("has_end").alias("has_end"),
    )


def best_hit(hits: DataFrame, key: str, score: str, *value: str) -> DataFrame:
    """Per key the values of the highest score; ties go to the largest values."""
    return hits.groupBy(key).agg(F.max_by(F.struct(*value), F.struct(F.col(score), *value)).alias("hit"), F.max(score).alias("score"))


def missing_neighbours(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(node, neighbour, genome): genomes that have a node's neighbour but not the node; where to look for it again.

    edges (u, v), members (node, genome). Genomes are bits: an edge carries the bitmaps of both its ends and only the
    genomes that one of them lacks become rows, where most neighbours share nearly all. A null genome equals none.
    ``members`` is read twice.
    """
    from strandloom.operators.dbg import dense_ids

    numbered = dense_ids(members.select("genome").distinct(), "genome", "_i").withColumn("_i", F.col("_i") - 1)
    numbered = written(numbered, "genomes")
    words = width(numbered.count())
    at = members.join(numbered, members["genome"].eqNullSafe(numbered["genome"])).select("node", F.col("_i").alias("genome_id"))
    sets = written(bitmaps(at, ["node"], "has", words), "sets")
    void = F.array_repeat(F.lit(0).cast("long"), words)
    nulls = numbered.where("genome IS NULL").first()
    never = F.array(*[F.lit((1 << (nulls["_i"] % 64)) - (1 << 64 if nulls["_i"] % 64 == 63 else 0) if nulls is not None and w == nulls["_i"] // 64 else 0).cast("long") for w in range(words)])
    one, two = sets.select(F.col("node").alias("u"), F.col("has").alias("hu")), sets.select(F.col("node").alias("v"), F.col("has").alias("hv"))
    met = edges.select("u", "v").join(one, "u", "left").join(two, "v", "left").select("u", "v", F.coalesce("hu", void).alias("hu"), F.coalesce("hv", void).alias("hv"))
    lacks = lambda has, own: without(has, without(own, never))
    sides = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("neighbour"), lacks(F.col("hv"), F.col("hu")).alias("g")), F.struct(F.col("v").alias("node"), F.col("u").alias("neighbour"), lacks(F.col("hu"), F.col("hv")).alias("g")))
    found = met.select(F.explode(sides).alias("x")).where(some(F.col("x.g"))).select("x.node", "x.neighbour", F.explode(bits(F.col("x.g"))).alias("_i"))
    return found.join(numbered, "_i").select("node", "neighbour", "genome")
