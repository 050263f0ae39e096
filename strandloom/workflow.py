"""Gene calling and the gene graph from contigs to tables, as one plan over the operators.

Contigs -> ORFs of both strands -> one start a stop -> scores -> overlaps -> the best set of genes on each contig ->
clusters -> shared scores -> gene graph -> paralogs, families -> names, presence, text. Stages are written to the shared
folder where several others read them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import bestpath, calling, cluster, dbg, families, filters, genegraph, genemodel, kmer, matrix, orf, overlap, refind
from strandloom.session import written
from strandloom.sources import fasta, saved, tables


@dataclass
class Settings:
    """Thresholds, as a user of gene callers knows them."""

    min_len: int = 90
    starts: tuple[str, ...] = S.START_CODONS
    stops: tuple[str, ...] = S.STOP_CODONS
    max_overlap: int = 60
    min_orf_score: float = 100.0
    min_path_score: float = 100.0
    protein_k: int = 10
    len_cutoff: float = 0.98
    identity: float = 0.98
    family_identity: float = 0.7
    #: How the graph is cleaned: strict, moderate or sensitive. Supports that are given override the mode's.
    mode: str = "strict"
    trailing_support: int | None = None
    edge_support: int | None = None
    edge_share: float = 0.05
    max_distance: int = 10_000
    core: float = 0.95
    find_missing: bool = True
    #: Models of coding sequences and of start sites: sequences in, probabilities out. Without one, 1 and a half.
    gene_scorer: calling.Scorer | None = None
    start_scorer: calling.Scorer | None = None
    #: Without them: models that each genome's ORFs of ``train_len`` bases teach, in place of 1 and a half.
    self_trained: bool = False
    train_len: int = 300
    annotations: DataFrame | None = field(default=None, repr=False)  # (query: cluster id as text, hit, bitscore, title)


@dataclass(frozen=True)
class Cleaning:
    """Genes at the ends of the graph in fewer genomes than ``trailing_support`` go, ``rounds`` times; edges in fewer
    than ``edge_support`` go where they look like misassemblies."""

    trailing_support: int
    rounds: int
    edge_support: int


def cleaning(s: Settings, n_genomes: int) -> Cleaning:
    """The supports of a mode, which grow with the number of genomes, from two on."""
    share = lambda x: max(2, math.ceil(x * n_genomes))
    modes = {"strict": Cleaning(share(0.05), 1_000, share(0.01)), "moderate": Cleaning(share(0.01), 1_000, share(0.01)), "sensitive": Cleaning(2, 0, 0)}
    if s.mode not in modes:
        raise ValueError(f"mode {s.mode} is none of {', '.join(modes)}")
    own = modes[s.mode]
    return Cleaning(own.trailing_support if s.trailing_support is None else s.trailing_support, own.rounds, own.edge_support if s.edge_support is None else s.edge_support)


def read_genomes(spark: SparkSession, listing: str) -> DataFrame:
    """(genome_id, isolate, contig_id, seq) of the FASTA files that a list of paths names."""
    paths = fasta.read_paths(spark, listing)
    records = fasta.read_fasta(spark, [r.path for r in paths.select("path").collect()])  # a row a genome
    name = F.regexp_replace("path", "^file:/*", "/").alias("file")
    named = paths.select(name, F.col("genome_id").cast("long").alias("genome_id"), "isolate")
    return records.select(name, F.col("record").cast("long").alias("contig_id"), "seq").join(F.broadcast(named), "file").select("genome_id", "isolate", "contig_id", "seq")


def called(contigs: DataFrame, s: Settings) -> DataFrame:
    """(genome_id, orf_id, contig_id, strand, start, end, len, dna, protein, tis, score, partial5, partial3): for each
    stop its start, of a good score, one of equal sequences of a genome."""
    pieces = contigs.select("genome_id", "contig_id", F.regexp_replace(F.upper("seq"), "[^ACGT]", "N").alias("seq"))
    found = written(orf.both_strands(pieces, ["genome_id", "contig_id"], "seq", s.min_len, s.starts, s.stops).where(~F.col("dna").contains("N")), "orfs")
    # what ends at one stop: the stop's place on the forward strand, and for those that run off the contig their frame
    group = F.struct("genome_id", "contig_id", "strand")
    sites = found.withColumn("site", S.translate_full(F.substr("dna", F.lit(1), F.lit(12))))
    counts = kmer.genome_counts(sites, "genome_id", "site").withColumnRenamed("n_genomes", "site_genomes")
    freq = orf.stop_frequency(pieces, "seq", s.stops)
    if s.start_scorer or s.self_trained:
        windows = written(calling.start_windows(pieces, found, ["genome_id", "contig_id"], "seq"), "windows")
        windows = windows.where("window IS NOT NULL")
        scored = (calling.score_distinct(windows, "window", s.start_scorer, "tis") if s.start_scorer else _own_starts(windows, found, s)).drop("window")
        # without enough bases before it a start is as likely as not
        sites = sites.join(scored, ["genome_id", "contig_id", "strand", "start", "end"], "left").withColumn("tis", F.coalesce("tis", F.lit(0.5)))
    else:
        sites = sites.withColumn("tis", F.lit(0.5))
    shape = F.struct("start", "end", "partial5", "partial3", "dna", "tis")
    starts = written(sites.join(counts, "site").select(group.alias("id"), "frame", F.coalesce("stop", F.lit(-1)).alias("stop"), F.when(F.col("strand") > 0, F.col("start")).otherwise(F.col("end")).alias("start"), "len", "tis", "site_genomes", F.lit(freq).alias("stop_freq"), "site", shape.alias("orf")), "starts")
    best = calling.choose_starts(starts.drop("orf")).select("id", "frame", "stop", "start")
    one = starts.join(best, ["id", "frame", "stop", "start"]).select("id.*", "len", "orf.*")
    if s.gene_scorer:
        gene = calling.score_distinct(one, "dna", s.gene_scorer, "gene")
    elif s.self_trained:
        odds = genemodel.self_trained(written(one.select("genome_id", F.col("dna").alias("seq")), "starts"), pieces.select("genome_id", "seq"), s.train_len)
        gene = one.join(odds.select("genome_id", F.col("seq").alias("dna"), genemodel.probability(F.col("odds")).alias("gene")), ["genome_id", "dna"])
    else:
        gene = one.withColumn("gene", F.lit(1.0))
    scored = gene.withColumn("score", calling.orf_score(F.col("gene"), F.col("tis"), F.substr("dna", F.lit(1), F.lit(3)), F.col("len"))).where(filters.good_score(F.col("score"), s.min_orf_score))
    by = Window.partitionBy("genome_id").orderBy("contig_id", "start", "end", "strand")
    numbered = scored.withColumns({"orf_id": F.row_number().over(by).cast("long"), "n_nodes": F.lit(1)})
    return calling.without_copies(numbered, "genome_id", "dna", "n_nodes").drop("n_nodes").withColumn("protein", orf.protein_to_stop("dna"))


def _own_starts(windows: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """``windows`` with ``tis``: how much each looks like the first starts of its genome's long ORFs."""
    stops = ["genome_id", "contig_id", "strand", "frame", "stop"]
    first = found.where((F.col("len") >= s.train_len) & ~F.col("partial5")).groupBy(*stops).agg(F.max_by(F.struct("start", "end"), "len").alias("x")).select("genome_id", "contig_id", "strand", "x.start", "x.end")
    training = windows.join(first, ["genome_id", "contig_id", "strand", "start", "end"], "left_semi").select("genome_id", F.col("window").alias("seq"))
    odds = genemodel.log_odds(windows.select("genome_id", F.col("window").alias("seq")), genemodel.start_models(training), genemodel.window_slots, "odds")
    return windows.join(odds.select("genome_id", F.col("seq").alias("window"), genemodel.probability(F.col("odds")).alias("tis")), ["genome_id", "window"])


def on_best_paths(orfs: DataFrame, s: Settings) -> DataFrame:
    """The ORFs of the heaviest set on each contig."""
    key = F.concat_ws(":", "genome_id", "contig_id")
    placed = orfs.select(key.alias("key"), F.col("orf_id").alias("orf"), "start", "end", "strand", "score")
    kept = bestpath.best_paths(placed, overlap.classify(placed.drop("score"), s.max_overlap), s.min_path_score)
    return orfs.withColumn("key", key).join(kept.select("key", F.col("orf").alias("orf_id")), ["key", "orf_id"], "left_semi").drop("key")


def _pairs(items: DataFrame, k: int, len_cutoff: float, identity: float) -> DataFrame:
    """Proteins (item, seq) close to the longest of those with a word of ``k`` letters in common."""
    if k <= 12:
        return cluster.protein_pairs(items, k, len_cutoff, identity)
    nodes = items.select("item", F.explode(F.array_distinct(S.kmers(F.col("seq"), k))).alias("node"))
    return cluster.centroid_pairs(items, nodes, len_cutoff, identity)


def clustered(orfs: DataFrame, s: Settings) -> DataFrame:
    """(cluster, genome_id, orf_id): greedy clusters of the distinct proteins, with ids from 1; members whose own score
    falls below the least with their centroid's gene probability are lost."""
    items = written(orfs.select(F.md5("protein").alias("item"), F.col("protein").alias("seq")).distinct(), "proteins")
    pairs = written(_pairs(items, s.protein_k, s.len_cutoff, s.identity), "pairs")
    groups = written(cluster.greedy(items, pairs), "clusters")
    ids = dbg.dense_ids(groups.select("centroid").distinct(), "centroid", "cluster")
    return written(groups.join(ids, "centroid").join(orfs.select(F.md5("protein").alias("member"), "genome_id", "orf_id"), "member").select(F.col("cluster").cast("long").alias("cluster"), "genome_id", "orf_id"), "members")


def graph_of(orfs: DataFrame, members: DataFrame, s: Settings, n_genomes: int) -> dict[str, DataFrame]:
    """nodes (node, genome, orf, ...) and edges (u, v, n_genomes, genomes) of the cleaned gene graph, after paralogs and
    families are merged."""
    m = members.select("cluster", F.col("genome_id").alias("genome"), F.col("orf_id").alias("orf"))
    split = written(genegraph.split_paralogs(m), "split")
    steps = families.connect_orfs(orfs.select(F.col("genome_id").alias("genome"), "contig_id", F.col("orf_id").alias("orf"), "start", "end"), s.max_distance)
    edges = written(genegraph.edges_of(genegraph.cluster_steps(steps, split.select("genome", "orf", F.col("node").alias("cluster")))), "edges")
    # copies of a cluster in several genomes are matched by their surroundings
    copies = split.join(genegraph.paralogs(m).select("cluster"), "cluster", "left_semi").select("cluster", "node", "genome")
    paralogs = written(families.collapse_paralogs(copies, edges) if not copies.isEmpty() else copies.select("node", F.col("node").alias("merged")).limit(0), "paralogs")
    named = written(split.join(paralogs, "node", "left").select(F.coalesce("merged", "node").alias("node"), "cluster", "genome", "orf"), "named")
    edges = written(genegraph.edges_of(genegraph.cluster_steps(steps, named.select("genome", "orf", F.col("node").alias("cluster")))), "edges")
    # families: clusters that are alike and near each other, in no genome both
    seqs = named.join(orfs.select(F.col("genome_id").alias("genome"), F.col("orf_id").alias("orf"), "protein"), ["genome", "orf"]).groupBy("node").agg(F.min_by("protein", F.struct(-F.length("protein"), "protein")).alias("seq"))
    seqs = written(seqs, "centroids")
    near = seqs.select(F.col("node").alias("item"), "seq")
    alike = _pairs(near, 5, s.family_identity, s.family_identity).select(F.col("centroid").alias("a"), F.col("member").alias("b"), "identity")
    alike = written(alike, "alike")  # each depth reads them
    merged = families.collapse_families(named.select("node", "genome").distinct(), edges, alike, s.family_identity)
    final = written(named.join(merged, "node").select(F.col("merged").alias("node"), "genome", "orf"), "final")
    edges = written(genegraph.edges_of(genegraph.cluster_steps(steps, final.select("genome", "orf", F.col("node").alias("cluster")))), "edges")
    sizes = written(final.groupBy("node").agg(F.count_distinct("genome").alias("size")), "sizes")
    clean = cleaning(s, n_genomes)
    kept, edges = genegraph.trim_ends(sizes, edges, clean.trailing_support, clean.rounds)
    kept, edges = written(kept, "kept"), written(edges, "edges")
    ends = kept.join(genegraph.degrees(edges).select("node", "has_end"), "node", "left").withColumn("has_end", F.coalesce("has_end", F.lit(True)))
    edges = written(genegraph.clean_edges(ends, edges, clean.edge_support, s.edge_share), "edges")
    return {"members": written(final.join(kept.select("node"), "node", "left_semi"), "members"), "edges": edges, "sizes": written(ends, "sizes")}


def missing_genes(contigs: DataFrame, orfs: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """Genes found again beside their neighbours in genomes that seem to lack them, as ``refind`` gives them."""
    members = graph["members"]
    searches = genegraph.missing_neighbours(graph["edges"].select("u", "v"), members.select("node", "genome"))
    places = orfs.select(F.col("genome_id").alias("genome"), F.col("orf_id").alias("orf"), "contig_id", "start", "end", "dna", "protein")
    genes = members.join(places, ["genome", "orf"])
    cut = refind.windows(searches, genes.select("node", "genome", "contig_id", "start", "end"), contigs.select(F.col("genome_id").alias("genome"), "contig_id", "seq"))
    centroids = genes.groupBy("node").agg(F.min_by(F.struct("dna", "protein"), F.struct(-F.length("dna"), "dna")).alias("c")).select("node", "c.dna", "c.protein")
    return refind.refind(cut, centroids)


def run(contigs: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """All tables from contigs (genome_id: long, contig_id: long, seq): orfs, clusters, members, edges, genes, presence
    and, if ``find_missing``, refound.

    Genes that were found again count as present, with negative orf ids. Null and short sequences give no ORF; an empty
    table gives empty tables.
    """
    s = settings or Settings()
    contigs = written(contigs.select("genome_id", "contig_id", F.upper("seq").alias("seq")), "contigs")
    orfs = written(on_best_paths(written(called(contigs, s), "called"), s), "genes")
    members = clustered(orfs, s)
    graph = graph_of(orfs, members, s, contigs.select("genome_id").distinct().count())
    out = {"orfs": orfs, "clusters": members, "edges": graph["edges"]}
    own = graph["members"].select("node", "genome", "orf")
    if s.find_missing:
        out["refound"] = written(missing_genes(contigs, orfs, graph), "refound")
        own = own.unionByName(out["refound"].select("node", "genome", F.col("orf_id").cast("long").alias("orf")))
    out["members"] = written(own, "members")
    ids = dbg.dense_ids(out["members"].select("node").distinct(), "node", "cluster_id")
    hits = s.annotations
    best = genegraph.best_hit(hits.select(F.col("query").cast("long").alias("cluster_id"), "hit", "bitscore", "title"), "cluster_id", "bitscore", "hit", "title").select("cluster_id", F.array("hit.hit").alias("annotations"), "score") if hits is not None else None
    genes = written(ids, "ids")
    labelled = genes.join(best, "cluster_id", "left") if best is not None else genes.withColumns({"annotations": F.lit(None).cast("array<string>"), "score": F.lit(0.0)})
    names = matrix.gene_names(labelled.select("cluster_id", F.coalesce("annotations", F.array().cast("array<string>")).alias("annotations")))
    out["genes"] = written(labelled.join(names, "cluster_id").join(graph["sizes"].select("node", "size", "has_end"), "node", "left"), "named")
    out["presence"] = written(matrix.presence(out["members"].join(out["genes"].select("node", "name"), "node"), "genome", "name"), "presence")
    return out


def write(results: dict[str, DataFrame], contigs: DataFrame, folder: str) -> None:
    """The results as files in ``folder``: saved tables, Rtab, wide table, GFF3, gene FASTA, GML, frequency classes,
    PHYLIP distances. ``contigs`` needs ``isolate`` beside genome_id."""
    names = contigs.select(F.col("genome_id").alias("genome"), "isolate").distinct()
    isolates = [r.isolate for r in names.orderBy("isolate").select("isolate").collect()]  # a row a genome
    genes = results["genes"].select("node", "cluster_id", "name", "size")
    saved.save(results["orfs"], "orfs", f"{folder}/orfs")
    saved.save(results["clusters"].withColumnRenamed("cluster", "cluster_id"), "clusters", f"{folder}/clusters")
    placed = results["orfs"].select(F.col("genome_id").alias("genome"), F.col("orf_id").alias("orf"), "contig_id", "start", "end", "strand", "dna", "protein", "len")
    rows = results["members"].join(genes, "node").join(names, "genome").join(placed, ["genome", "orf"])
    pairs = matrix.presence(results["presence"].join(names, "genome").select("gene", "isolate"), "isolate", "gene")
    matrix.rtab(pairs, isolates).write.csv(f"{folder}/gene_presence_absence.Rtab", sep="\t", header=True)
    matrix.frequency_classes(pairs).write.csv(f"{folder}/summary_statistics.txt", sep="\t")
    wide = rows.select(F.col("name").alias("gene"), F.col("isolate").alias("genome"), "orf", F.col("len").alias("length"), F.lit("").alias("annotation"))
    matrix.roary_table(wide, isolates).write.csv(f"{folder}/gene_presence_absence_roary.csv", header=True)
    gff = rows.select("isolate", F.col("contig_id").cast("string").alias("contig"), (F.col("start") + 1).alias("start"), "end", F.when(F.col("strand") > 0, "+").otherwise("-").alias("strand"), F.concat_ws("_", "isolate", "orf").alias("id"), "name", F.lit("hypothetical protein").alias("product"))
    tables.gff3_lines(gff).write.partitionBy("isolate").text(f"{folder}/GFF")
    lines = rows.select("isolate", F.col("orf").alias("orf_id"), F.col("cluster_id").alias("cluster"), F.lit(None).cast("string").alias("annotation"), F.lit(False).alias("pseudo"), "dna", "protein")
    fasta.gene_fasta(lines).write.text(f"{folder}/gene_calls.ffn")
    fasta.gene_fasta(lines, protein=True).write.text(f"{folder}/gene_calls.faa")
    tables.gml_lines(genes.select("node", F.col("name").alias("label"), "size"), results["edges"].select("u", "v", "n_genomes")).orderBy("part").select("value").coalesce(1).write.text(f"{folder}/final_graph.gml")
    tables.phylip_lines(matrix.gene_distances(pairs), pairs.select(F.col("genome").alias("id")).distinct()).select("value").write.text(f"{folder}/gene_distances.phylip")
