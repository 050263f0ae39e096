"""A coloured, compacted de Bruijn graph of contigs, as tables.

K-mers are nodes, and an edge joins two that follow each other somewhere. Unitigs are the chains between branches.
Strands: a k-mer and its reverse complement are one (canonical) node; how a contig reads it is its sign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import kmers, reverse_complement, split_n
from strandloom.operators.kmer import kmer_counts, spelled
from strandloom.session import discard, written


def pieces(contigs: DataFrame) -> DataFrame:
    """(genome_id, contig_id, piece, seq): contigs cut at runs of N."""
    return contigs.select("genome_id", "contig_id", F.posexplode(split_n(F.col("seq"))).alias("piece", "seq"))


def placed_kmers(cut: DataFrame, k: int) -> DataFrame:
    """(genome_id, contig_id, piece, pos, kmer, strand): canonical k-mers in order; strand is 1 if read as they are."""
    each = cut.where(F.length("seq") >= k).select("genome_id", "contig_id", "piece", F.posexplode(kmers(F.col("seq"), k)).alias("pos", "x"))
    both = each.where(~F.col("x").rlike("[^ACGT]")).withColumn("r", reverse_complement(F.col("x")))
    return both.select("genome_id", "contig_id", "piece", "pos", F.least("x", "r").alias("kmer"), F.when(F.col("x") <= F.col("r"), 1).otherwise(-1).alias("strand"))


def colours(placed: DataFrame) -> DataFrame:
    """(kmer, genome_id): which genomes have a k-mer."""
    return placed.select("kmer", "genome_id").distinct()


def drop_rare(placed: DataFrame, least: int = 2) -> DataFrame:
    """For reads: only k-mers seen at least ``least`` times."""
    common = placed.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("kmer")
    return placed.join(common, "kmer", "left_semi")


def placed_of(refs: DataFrame | None, reads: DataFrame | None, k: int, least: int = 2) -> DataFrame:
    """Placed k-mers of assemblies, of reads, or of both: all of the assemblies', and of the reads' those seen ``least``
    times in the reads. refs and reads (genome_id, contig_id, seq); a read is a contig of its genome."""
    made = ([placed_kmers(pieces(refs), k)] if refs is not None else []) + ([drop_rare(written(placed_kmers(pieces(reads), k), "read-kmers"), least)] if reads is not None else [])
    if not made:
        raise ValueError("neither assemblies nor reads")
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def counts_of(refs: DataFrame | None, reads: DataFrame | None, k: int, least: int = 2, prose: bool = False) -> DataFrame:
    """(kmer, n): how many ``placed_of`` there are of each k-mer, counted as numbers without placing them. refs and reads (seq)."""
    made = ([kmer_counts(refs, "seq", k, prose)] if refs is not None else []) + ([kmer_counts(reads, "seq", k, prose).where(F.col("n") >= least)] if reads is not None else [])
    if not made:
        raise ValueError("neither assemblies nor reads")
    return spelled(made[0] if len(made) == 1 else made[0].unionByName(made[1]).groupBy("kmer").agg(F.sum("n").alias("n")), k)


def sides(placed: DataFrame) -> DataFrame:
    """(kmer, side, other, other_side): links between k-mer ends, both ways, once each.

    Side 1 is the end a k-mer is left by when read as it is, side -1 its beginning. Reading strand s then t joins side
    s of the first to side -t of the second.
    """
    by = Window.partitionBy("genome_id", "contig_id", "piece").orderBy("pos")
    nxt = placed.select("pos", "kmer", "strand", F.lead(F.struct("pos", "kmer", "strand")).over(by).alias("n")).where("n.pos = pos + 1")
    one = nxt.select("kmer", F.col("strand").alias("side"), F.col("n.kmer").alias("other"), (-F.col("n.strand")).alias("other_side")).distinct()
    flipped = one.select(F.col("other").alias("kmer"), F.col("other_side").alias("side"), F.col("kmer").alias("other"), F.col("side").alias("other_side"))
    return one.unionByName(flipped).distinct()


def chain_links(links: DataFrame) -> DataFrame:
    """Links inside unitigs: both ends have no other link, and it is not a k-mer's link with itself."""
    single = links.groupBy("kmer", "side").agg(F.count("*").alias("n"), F.first("other").alias("other"), F.first("other_side").alias("other_side")).where("n = 1").drop("n")
    back = single.select(F.col("kmer").alias("o2"), F.col("side").alias("s2"))
    return single.join(back, (F.col("other") == F.col("o2")) & (F.col("other_side") == F.col("s2"))).where("kmer <> other").select("kmer", "side", "other", "other_side")


def unitigs(placed: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(kmer, unitig, offset, strand): every k-mer's place in its unitig, which is named by a k-mer.

    Pointer doubling over directed k-mers (a k-mer with a reading direction): each knows the one ``2**round`` steps
    back, so a chain of n k-mers takes log2(n) joins, each written to the shared folder. A unitig is read from the end
    whose k-mer is smaller; one that closes on itself starts at its smallest k-mer.
    """
    nodes = placed.select("kmer").distinct()
    directed = nodes.select("kmer", F.explode(F.array(F.lit(1), F.lit(-1))).alias("dir"))
    # leaving kmer by side d enters other by other_side, so it is read in direction -other_side
    inner = chain_links(sides(placed))
    prev = inner.select(F.col("other").alias("kmer"), (-F.col("other_side")).alias("dir"), F.col("kmer").alias("p"), F.col("side").alias("pd"))
    state = directed.join(prev, ["kmer", "dir"], "left").select(
        "kmer", "dir", F.coalesce("p", "kmer").alias("at"), F.coalesce("pd", "dir").alias("at_dir"), F.col("p").isNotNull().cast("long").alias("steps"), F.least("kmer", F.coalesce("p", "kmer")).alias("low"), F.col("p").isNull().alias("done")
    )
    state = written(state, "chains")
    # of the open ones: how many, and what they have seen
    openness = lambda s: tuple(s.where("not done").agg(F.count("*"), F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first())
    before = openness(state)
    for n_round in range(max_rounds):
        if not before[0]:
            break
        far = state.select(F.col("kmer").alias("at"), F.col("dir").alias("at_dir"), F.col("at").alias("a2"), F.col("at_dir").alias("d2"), F.col("steps").alias("s2"), F.col("low").alias("l2"), F.col("done").alias("f2"))
        loops = (F.col("a2") == F.col("kmer")) & (F.col("d2") == F.col("dir"))
        joined = state.where("not done").join(far, ["at", "at_dir"])
        step = joined.select("kmer", "dir", F.col("a2").alias("at"), F.col("d2").alias("at_dir"), (F.col("steps") + F.col("s2")).alias("steps"), F.least("low", "l2").alias("low"), "f2", loops.alias("loop"))
        nxt = step.select("kmer", "dir", "at", "at_dir", "steps", "low", F.col("f2").alias("done"))
        new = written(state.where("done").unionByName(nxt), "chains")
        discard(state)
        now, state = openness(new), new
        # only cycles never finish: when a round changes nothing, what is left is cycles that have seen all of themselves
        if now == before and n_round >= 1:
            break
        before = now
    chains = state.where("done").select("kmer", "dir", F.col("at").alias("head"), F.col("at_dir").alias("head_dir"), F.col("steps").alias("offset"))
    # a chain is there in both directions: keep the reading that starts at the smaller end
    ends = chains.groupBy("head", "head_dir").agg(F.max(F.struct("offset", "kmer", "dir")).alias("tail"))
    other = ends.select(F.col("head").alias("h"), F.col("head_dir").alias("hd"), F.col("tail.kmer").alias("t"), F.col("tail.dir").alias("td"))
    keep = other.where((F.col("h") < F.col("t")) | ((F.col("h") == F.col("t")) & (F.col("hd") >= -F.col("td")) & (F.col("hd") == 1)))
    linear = chains.join(keep, (F.col("head") == F.col("h")) & (F.col("head_dir") == F.col("hd"))).select("kmer", F.col("head").alias("unitig"), "offset", F.col("dir").alias("strand"))
    cycles = state.where("not done")
    if cycles.isEmpty():
        return linear
    return linear.unionByName(_open_cycles(cycles.select("kmer", "dir", "low"), inner))


def _open_cycles(cycles: DataFrame, inner: DataFrame) -> DataFrame:
    """Cut each cycle before its smallest k-mer, read as it is, and number it from there by doubling."""
    heads = cycles.where("kmer = low AND dir = 1").select("kmer", "dir")
    prev = inner.select(F.col("other").alias("kmer"), (-F.col("other_side")).alias("dir"), F.col("kmer").alias("p"), F.col("side").alias("pd"))
    cut = cycles.select("kmer", "dir").join(prev, ["kmer", "dir"]).join(heads.withColumn("head", F.lit(True)), ["kmer", "dir"], "left")
    state = written(cut.select("kmer", "dir", F.when(F.col("head"), F.col("kmer")).otherwise(F.col("p")).alias("at"), F.when(F.col("head"), F.col("dir")).otherwise(F.col("pd")).alias("at_dir"), F.when(F.col("head"), 0).otherwise(1).cast("long").alias("steps"), F.coalesce("head", F.lit(False)).alias("done")), "cycles")
    for _ in range(40):
        far = state.select(F.col("kmer").alias("at"), F.col("dir").alias("at_dir"), F.col("at").alias("a2"), F.col("at_dir").alias("d2"), F.col("steps").alias("s2"), F.col("done").alias("f2"))
        new = written(state.where("done").unionByName(state.where("not done").join(far, ["at", "at_dir"]).select("kmer", "dir", F.col("a2").alias("at"), F.col("d2").alias("at_dir"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("f2").alias("done"))), "cycles")
        if new.where("done").count() == state.where("done").count():
            break
        state = new
    return state.where("done").select("kmer", F.col("at").alias("unitig"), F.col("steps").alias("offset"), F.col("dir").alias("strand"))


def unitig_table(members: DataFrame, k: int) -> DataFrame:
    """(node_id, unitig, seq, size): ids are dense, in the order of the naming k-mers' hashes, and so stable."""
    read = members.select("unitig", "offset", F.when(F.col("strand") == 1, F.col("kmer")).otherwise(reverse_complement(F.col("kmer"))).alias("x"))
    parts = read.groupBy("unitig").agg(F.array_sort(F.collect_list(F.struct("offset", "x"))).alias("p"))
    seq = F.concat(F.get("p", 0)["x"], F.array_join(F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda s: F.substr(s["x"], F.lit(k), F.lit(1))), ""))
    out = parts.select("unitig", seq.alias("seq")).withColumn("size", F.length("seq"))
    return dense_ids(out, "unitig", "node_id")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number distinct keys from 1 without sorting all in one task: ranks within 4,096 hash ranges, plus the sizes of
    the ranges before, which are few."""
    ranged = df.withColumn("_r", F.pmod(F.xxhash64(key), F.lit(4096)).cast("int"))
    before = ranged.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy(key)))
    return ranked.join(F.broadcast(before), "_r").withColumn(name, F.col("_before") + F.col("_k")).drop("_r", "_k", "_before")  # 4,096 rows at most


def genome_paths(placed: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(genome_id, contig_id, piece, pos, node_id, contig_end, at, size): signed unitigs in the order a contig passes
    them; the unitig lies on the piece from base ``at`` on, which is negative where a contig begins inside it.

    A unitig entered again right after it ended is a new step, so steps begin where the unitig changes or the offset
    does not continue.
    """
    ids = nodes.select("unitig", "node_id", "size")
    steps = placed.join(members.select("kmer", "unitig", "offset", F.col("strand").alias("us")), "kmer").withColumn("sign", F.col("strand") * F.col("us"))
    by = Window.partitionBy("genome_id", "contig_id", "piece").orderBy("pos")
    run = steps.withColumn("before", F.lag(F.struct("unitig", "offset", "sign", "pos")).over(by))
    same = (F.col("before.unitig") == F.col("unitig")) & (F.col("before.sign") == F.col("sign")) & (F.col("offset") == F.col("before.offset") + F.col("sign")) & (F.col("pos") == F.col("before.pos") + 1)
    new = run.where(~F.coalesce(same, F.lit(False))).join(ids, "unitig")
    ordered = new.withColumns({"step": F.row_number().over(by), "contig_end": F.lag(F.lit(1)).over(by).isNull() | F.lead(F.lit(1)).over(by).isNull()})
    inside = F.when(F.col("sign") == 1, F.col("offset")).otherwise(F.col("size") - F.length("kmer") - F.col("offset"))
    return ordered.select("genome_id", "contig_id", "piece", F.col("step").alias("pos"), (F.col("node_id") * F.col("sign")).alias("node_id"), "contig_end", (F.col("pos") - inside).alias("at"), "size")


def lift(orfs: DataFrame, node_paths: DataFrame, bin_size: int = 4096) -> DataFrame:
    """ORFs on pieces as node paths: orfs (genome_id, contig_id, piece, start, end) get coords, an array of
    (node, s, e) with the end exclusive.

    Contig paths are where an assembly's ORFs lie, so no search through the graph is needed. A range join by bins.
    """
    keys = ["genome_id", "contig_id", "piece"]
    spans = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / bin_size), F.floor((hi - 1) / bin_size)))
    left = orfs.select(*keys, "start", "end").distinct().withColumn("bin", spans(F.col("start"), F.col("end")))
    right = node_paths.select(*keys, "pos", "node_id", "at", "size").withColumn("bin", spans(F.col("at"), F.col("at") + F.col("size")))
    met = left.join(right, [*keys, "bin"]).where((F.col("at") < F.col("end")) & (F.col("at") + F.col("size") > F.col("start")))
    part = F.struct("pos", F.col("node_id").alias("node"), (F.greatest("start", "at") - F.col("at")).cast("int").alias("s"), (F.least("end", F.col("at") + F.col("size")) - F.col("at")).cast("int").alias("e"))
    parts = met.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_set(part)).alias("p"))
    return parts.select(*keys, "start", "end", F.transform("p", lambda x: F.struct(x["node"], x["s"], x["e"])).alias("coords"))
