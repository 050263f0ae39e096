"""Queries on coordinates of node paths, strands, scores and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import calling, cluster, dbg, filters, genegraph, paths, refind
from strandloom.operators.orf import both_strands, orf_pairs
from strandloom.plans.more_queries import K, _contigs
from strandloom.plans.orf_queries import BOTH_SQL, DNA_SQL, ORF_PAIRS_SQL
from strandloom.plans.registry import ORACLES, query
from strandloom.plans.sequence_queries import AA_SQL
from strandloom.session import balanced, table, written

OVERLAP = 15

# paths: a user's events in order are nodes, their sizes are made up
_STEPS = f"""p AS (SELECT user_id, event_id * CASE WHEN event_type = 'click' THEN -1 ELSE 1 END AS node, 40 + event_id % 50 AS size,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
r AS (SELECT *, coalesce(sum(size - {OVERLAP}) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM p),
n AS (SELECT *, s + size AS e FROM r)"""


def _steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", (F.col("event_id") * F.when(F.col("event_type") == "click", -1).otherwise(1)).alias("node"), (F.col("event_id") % 50 + 40).alias("size"))


def _paths(spark, sf_dir):
    """(user_id, nodes, sizes, ranges): a row a path."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "node", F.col("size").cast("int").alias("size"))))
    p = _steps(spark, sf_dir).groupBy("user_id").agg(listed.alias("x")).select("user_id", F.transform("x", lambda x: x["node"]).alias("nodes"), F.transform("x", lambda x: x["size"]).alias("sizes"))
    return p.withColumn("ranges", paths.node_ranges(F.col("nodes"), F.col("sizes"), OVERLAP))


@query("node_offsets", f"WITH {_STEPS} SELECT user_id, node, s, e FROM n")
def q_offsets(spark, sf_dir):
    """Where each node lies on its path, by a running sum."""
    return paths.placed_nodes(_steps(spark, sf_dir), ["user_id"], ["ts", "event_id"], "size", OVERLAP).select("user_id", "node", F.col("s"), F.col("e").cast("long").alias("e"))


@query("node_ranges", f"WITH {_STEPS} SELECT user_id, pos - 1 AS pos, node, s, e FROM n")
def q_ranges(spark, sf_dir):
    """The same as arrays."""
    p = _paths(spark, sf_dir).select("user_id", F.posexplode(F.arrays_zip("nodes", "ranges")).alias("pos", "x"))
    return p.select("user_id", F.col("pos").cast("long").alias("pos"), "x.nodes", F.col("x.ranges.s").cast("long").alias("s"), F.col("x.ranges.e").cast("long").alias("e")).withColumnRenamed("nodes", "node")


_CUT = f"WITH {_STEPS}, c AS (SELECT user_id, pos, node, size, greatest(70, s) - s AS a, least(330, e) - s AS b FROM n WHERE least(330, e) > greatest(70, s))"


def _cut(spark, sf_dir):
    """(user_id, coords, sizes): the path's bases from 70 to 330 on its nodes."""
    p = _paths(spark, sf_dir).withColumn("coords", paths.to_nodes(F.lit(70), F.lit(330), F.col("nodes"), F.col("ranges")))
    size = F.map_from_arrays("nodes", "sizes")
    return p.withColumn("sizes", F.transform("coords", lambda x: F.element_at(size, x["node"]))).where(F.size("coords") > 0)


def _exploded(df, column):
    return df.select("user_id", F.posexplode(column).alias("k", "x")).select("user_id", F.col("k").cast("long").alias("k"), "x.node", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"))


@query("linear_to_nodes", f"{_CUT} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS k, node, a AS s, b AS e FROM c")
def q_to_nodes(spark, sf_dir):
    return _exploded(_cut(spark, sf_dir), F.col("coords"))


@query("drop_short_nodes", f"{_CUT} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS k, node, a AS s, b AS e FROM c WHERE b - a > {OVERLAP}")
def q_drop_short(spark, sf_dir):
    return _exploded(_cut(spark, sf_dir), paths.drop_short(F.col("coords"), OVERLAP))


@query("simplified_orfs", f"""{_CUT}, w AS (SELECT *, min(CASE WHEN b - a > 45 THEN pos END) OVER (PARTITION BY user_id) AS lo, max(CASE WHEN b - a > 45 THEN pos END) OVER (PARTITION BY user_id) AS hi FROM c)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS k, node, a AS s, b AS e FROM w WHERE pos BETWEEN lo AND hi""")
def q_simplified(spark, sf_dir):
    """Nodes at the ends that are covered by 45 bases or less go."""
    return _exploded(_cut(spark, sf_dir), paths.simplify(F.col("coords"), 45))


@query("reversed_orfs", f"{_CUT} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) - 1 AS k, -node AS node, size - b AS s, size - a AS e FROM c")
def q_reversed(spark, sf_dir):
    return _exploded(_cut(spark, sf_dir), paths.reverse_coords(F.col("coords"), F.col("sizes")))


@query("reversed_paths", f"WITH {_STEPS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) - 1 AS pos, -node AS node FROM p")
def q_reversed_paths(spark, sf_dir):
    p = _paths(spark, sf_dir).select("user_id", F.posexplode(S.reverse_path(F.col("nodes"))).alias("pos", "node"))
    return p.withColumn("pos", F.col("pos").cast("long"))


@query("order_in_node", "SELECT l_orderkey, l_linenumber, l_partkey AS node, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_quantity + l_tax, l_orderkey, l_linenumber) AS pos FROM lineitem")
def q_order_in_node(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("node"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + F.col("l_tax")).alias("e"))
    return paths.order_in_node(c, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "node", F.col("pos").cast("long").alias("pos"))


@query("longest_path", "SELECT l_suppkey, arg_min(l_orderkey, row(-l_quantity, l_orderkey)) AS l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_suppkey")
def q_longest(spark, sf_dir):
    return paths.longest_path(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_orderkey")


# the graph: what its parts must add up to
_KMERS = f"""WITH s AS (SELECT item_id, {DNA_SQL} AS seq FROM benchmark), p AS (SELECT item_id, i, substr(seq, i, {K}) AS x FROM (SELECT *, unnest(range(1, greatest(length(seq) - {K - 2}, 1))) AS i FROM s)),
c AS (SELECT item_id, i, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, CASE WHEN x <= reverse(translate(x, 'ACGT', 'TGCA')) THEN 1 ELSE -1 END AS strand FROM p)"""


def _graph(spark, sf_dir):
    placed = written(dbg.placed_kmers(dbg.pieces(_contigs(spark, sf_dir)), K), "placed")
    members = written(dbg.unitigs(placed), "members")
    return placed, members, written(dbg.unitig_table(members, K), "unitigs")


@query("unitig_kmers", f"{_KMERS} SELECT DISTINCT kmer, 1::BIGINT AS n FROM c")
def q_unitig_kmers(spark, sf_dir):
    """The k-mers of the unitigs' sequences: every one of the contigs', once."""
    from strandloom.operators.kmer import kmer_table

    return kmer_table(_graph(spark, sf_dir)[2], "node_id", "seq", K, both_strands=True).groupBy("kmer").agg(F.count("*").alias("n"))


@query("unitig_counts", f"""{_KMERS}, l AS (SELECT a.kmer, a.strand AS side, b.kmer AS other, -b.strand AS other_side FROM c a JOIN c b ON a.item_id = b.item_id AND b.i = a.i + 1),
u AS (SELECT kmer, side, other, other_side FROM l UNION SELECT other, other_side, kmer, side FROM l), o AS (SELECT kmer, side FROM u GROUP BY ALL HAVING count(*) = 1),
i AS (SELECT count(*) // 2 AS n FROM u JOIN o USING (kmer, side) JOIN o q ON q.kmer = u.other AND q.side = u.other_side WHERE u.kmer <> u.other)
SELECT (SELECT count(DISTINCT kmer) FROM c) - n AS n_unitigs, ((SELECT count(DISTINCT kmer) FROM c) + ((SELECT count(DISTINCT kmer) FROM c) - n) * {K - 1})::BIGINT AS n_bases FROM i""")
def q_unitig_counts(spark, sf_dir):
    """As many unitigs as k-mers less the links inside chains: they are as long as can be."""
    return _graph(spark, sf_dir)[2].agg(F.count("*").alias("n_unitigs"), F.sum("size").alias("n_bases"))


@query("path_sequences", f"SELECT item_id AS genome_id, 0 AS piece, {DNA_SQL} AS seq FROM benchmark WHERE length({DNA_SQL}) >= {K}")
def q_path_sequences(spark, sf_dir):
    """Genome paths spelled with the unitigs: the contigs."""
    placed, members, unitigs = _graph(spark, sf_dir)
    steps = written(dbg.genome_paths(placed, members, unitigs), "paths")
    ends = placed.groupBy("genome_id", "contig_id", "piece").agg((F.max("pos") + K).alias("n"))
    met = steps.join(ends, ["genome_id", "contig_id", "piece"])
    at = F.struct("pos", F.col("node_id").alias("node"), F.greatest(-F.col("at"), F.lit(0)).cast("int").alias("s"), F.least("size", F.col("n") - F.col("at")).cast("int").alias("e"))
    listed = met.groupBy("genome_id", "piece").agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: F.struct(x["node"], x["s"], x["e"])).alias("coords"))
    return paths.path_sequence(listed, unitigs, ["genome_id", "piece"], K - 1)


@query("lifted_orfs", f"""WITH s AS (SELECT item_id, {DNA_SQL} AS seq FROM benchmark), w AS (SELECT item_id, seq, unnest(range(0, length(seq) - 59, 20)) AS start FROM s)
SELECT item_id AS genome_id, start, substr(seq, start + 1, 60) AS seq FROM w""")
def q_lifted(spark, sf_dir):
    """Stretches of 60 bases as node coordinates, spelled again."""
    placed, members, unitigs = _graph(spark, sf_dir)
    steps = written(dbg.genome_paths(placed, members, unitigs), "paths")
    c = _contigs(spark, sf_dir).where(F.length("seq") >= 60)
    orfs = c.select("genome_id", "contig_id", F.lit(0).alias("piece"), F.explode(F.sequence(F.lit(0), F.length("seq") - 60, F.lit(20))).alias("start")).withColumn("end", F.col("start") + 60)
    lifted = dbg.lift(orfs, steps)
    return paths.path_sequence(lifted, unitigs, ["genome_id", "start"], K - 1).select("genome_id", F.col("start").cast("long").alias("start"), "seq")


@query("dense_ids", "SELECT count(DISTINCT l_partkey) AS n, 1::BIGINT AS lo, count(DISTINCT l_partkey) AS hi FROM lineitem")
def q_dense(spark, sf_dir):
    ids = dbg.dense_ids(table(spark, sf_dir, "lineitem").select("l_partkey").distinct(), "l_partkey", "id")
    return ids.agg(F.count_distinct("id").alias("n"), F.min("id").cast("long").alias("lo"), F.max("id").cast("long").alias("hi"))


# strands: suppliers are read with their nation, whose sign is that of the balance
_SIGN = "CASE WHEN s_acctbal < 0 THEN -1 ELSE 1 END"


def _strand_orfs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    sign = F.when(F.col("s_acctbal") < 0, -1).otherwise(1)
    return s.select(F.col("s_nationkey").cast("long").alias("genome_id"), F.col("s_suppkey").alias("orf_id"), F.array((F.col("s_nationkey") + 1).cast("long") * sign, F.col("s_suppkey") + 1000).alias("nodes"))


_CONSENSUS = f"""WITH RECURSIVE o AS (SELECT s_nationkey::BIGINT AS genome_id, s_suppkey AS orf_id, (s_nationkey + 1)::BIGINT * {_SIGN} AS x, s_suppkey + 1000 AS y FROM supplier),
b AS (SELECT x, y FROM o UNION SELECT -x, -y FROM o), e AS (SELECT x AS a, y AS b FROM b UNION SELECT y, x FROM b), z AS (SELECT a, CASE WHEN a > 0 THEN 2 * a ELSE 1 - 2 * a END AS c FROM e),
r(node, c) AS (SELECT a, c FROM z UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node), m AS (SELECT node, min(c) AS c FROM r GROUP BY node),
f AS (SELECT abs(node) AS node, arg_min(node > 0, row(c, node < 0)) AS forward FROM m GROUP BY abs(node))"""


@query("strand_consensus", f"{_CONSENSUS} SELECT node, forward FROM f")
def q_consensus(spark, sf_dir):
    return calling.strand_consensus(_strand_orfs(spark, sf_dir))


@query("strand_votes", f"""{_CONSENSUS}, v AS (SELECT genome_id, orf_id, unnest([x, y]) AS n FROM o)
SELECT genome_id, orf_id, sum(CASE WHEN (n > 0) = forward THEN 1 ELSE -1 END) >= 0 AS forward FROM v JOIN f ON f.node = abs(n) GROUP BY genome_id, orf_id""")
def q_votes(spark, sf_dir):
    orfs = written(_strand_orfs(spark, sf_dir), "orfs")
    return calling.strand_votes(orfs, calling.strand_consensus(orfs))


# scores
_W = calling.START_WEIGHT
_SCORE = f"""(l_discount * 10 * {calling.GENE_WEIGHT!r} + l_tax * 10 * {calling.TIS_WEIGHT!r} + CASE l_returnflag WHEN 'A' THEN {_W['ATG']!r} WHEN 'N' THEN {_W['GTG']!r} ELSE {_W['TTG']!r} END
  - {calling.THRESHOLD!r} * {calling.MAX_SCORE!r}) * (l_quantity * 3)"""


def _codon():
    return F.when(F.col("l_returnflag") == "A", "ATG").when(F.col("l_returnflag") == "N", "GTG").otherwise("TTG")


@query("orf_scores", f"SELECT l_orderkey, l_linenumber, round({_SCORE}, 6) AS score, {_SCORE} >= 100 AS good FROM lineitem")
def q_orf_scores(spark, sf_dir):
    score = calling.orf_score(F.col("l_discount") * 10, F.col("l_tax") * 10, _codon(), F.col("l_quantity") * 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), filters.good_score(score).alias("good"))


@query("mean_logits", "SELECT l_orderkey, round(1 / (1 + exp(-avg(ln((l_tax + 0.05) / (1 - (l_tax + 0.05)))))), 6) AS p FROM lineitem GROUP BY l_orderkey")
def q_logits(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_tax") + 0.05).alias("p"))
    return p.select("l_orderkey", F.round(calling.mean_logit(F.col("p")), 6).alias("p"))


@query("length_decay", "SELECT p_partkey, round(pow(1 - 3.0 / 64, floor(50.0 * 30 / 3) - floor(p_size * 30.0 / 3)), 9) AS p FROM part")
def q_decay(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(calling.length_decay(F.lit(1500), F.col("p_size") * 30, F.lit(3 / 64)), 9).alias("p"))


@query("median_quantity", "SELECT l_orderkey, median(l_quantity) AS m FROM lineitem GROUP BY l_orderkey")
def q_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(S.median(F.collect_list("l_quantity")).alias("m"))


_STARTS_SQL = f"""WITH o AS (SELECT doc_id, source, frame, o.start, stop, len, substr(seq, start + 1, 12) AS s FROM ({ORF_PAIRS_SQL}) o JOIN (SELECT doc_id, source, {DNA_SQL} AS seq FROM documents) d USING (doc_id)),
t AS (SELECT *, {AA_SQL} AS site FROM o), g AS (SELECT site, count(DISTINCT source) AS g FROM t GROUP BY site), a AS (SELECT t.*, g, (start % 7) / 7.0::DOUBLE AS tis FROM t JOIN g USING (site)),
f1 AS (SELECT doc_id, frame, stop, list_reduce(list({{'len': len, 'start': start, 'tis': tis, 'g': g, 'n': 0::BIGINT}} ORDER BY len DESC), VOTE) AS b FROM a GROUP BY ALL),
n AS (SELECT site, count(*) AS n FROM f1 JOIN a ON a.doc_id = f1.doc_id AND a.frame = f1.frame AND a.stop = f1.stop AND a.start = f1.b.start GROUP BY site),
f2 AS (SELECT doc_id, frame, stop, list_reduce(list({{'len': len, 'start': start, 'tis': tis, 'g': g, 'n': coalesce(n, 0)::BIGINT}} ORDER BY len DESC), VOTE) AS b FROM a LEFT JOIN n USING (site) GROUP BY ALL)
SELECT doc_id, frame, stop, b.start AS start, b.len AS len FROM f2""".replace("VOTE", f"""lambda w, x: CASE WHEN pow(1 - {3 / 64!r}, floor(w.len / 3) - floor(x.len / 3)) >= 0.2
  AND (x.g > w.g)::INT + (x.tis > w.tis)::INT + (x.n > w.n)::INT >= 2 THEN x ELSE w END""")


@query("start_choice_votes", _STARTS_SQL)
def q_start_votes(spark, sf_dir):
    """One start a stop by three votes; a number from the place stands for the start-site model."""
    from strandloom.operators.kmer import genome_counts

    d = balanced(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(F.struct("doc_id", "source").alias("k"), S.dna(F.col("text")).alias("seq"))
    o = orf_pairs(d, "k", "seq", with_dna=True).select("id.*", "frame", "stop", "start", "len", S.translate_full(F.substr("dna", F.lit(1), F.lit(12))).alias("site"))
    o = written(o, "starts")
    counts = genome_counts(o, "source", "site").withColumnRenamed("n_genomes", "site_genomes")
    starts = o.join(counts, "site").select(F.col("doc_id").alias("id"), "frame", "stop", "start", "len", (F.col("start") % 7 / 7).alias("tis"), "site_genomes", F.lit(3 / 64).alias("stop_freq"), "site")
    return calling.choose_starts(starts).select(F.col("id").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in ("frame", "stop", "start", "len")])


_MEMBERS = """m AS (SELECT user_id AS cluster, event_id AS member, (event_id % 11) / 10.0::DOUBLE AS p, (event_id % 7) / 6.0::DOUBLE AS tis, (event_id % 50) * 3 + 30 AS len,
  CASE event_id % 3 WHEN 0 THEN 'ATG' WHEN 1 THEN 'GTG' ELSE 'TTG' END AS codon FROM events)"""


#: start_choice is the same with one half for every start site.
ORACLES["start_choice"] = _STARTS_SQL.replace("(start % 7) / 7.0::DOUBLE AS tis", "0.5::DOUBLE AS tis")


@query("shared_scores", f"""
WITH {_MEMBERS}, c AS (SELECT cluster, min(member) AS head, arg_min(p, member) AS gene FROM m GROUP BY cluster),
s AS (SELECT head, member, round((gene * {calling.GENE_WEIGHT!r} + tis * {calling.TIS_WEIGHT!r} + CASE codon WHEN 'ATG' THEN {_W['ATG']!r} WHEN 'GTG' THEN {_W['GTG']!r} ELSE {_W['TTG']!r} END - 0.5) * len, 6) AS score FROM m JOIN c USING (cluster))
SELECT head AS centroid, member, score FROM s WHERE score >= 50 AND head IN (SELECT head FROM s WHERE member = head AND score >= 50)""")
def q_shared_scores(spark, sf_dir):
    """Members take the gene probability of their cluster's first member; clusters of a bad centroid go."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    codon = F.when(i % 3 == 0, "ATG").when(i % 3 == 1, "GTG").otherwise("TTG")
    m = e.select("user_id", i.alias("member"), (i % 11 / 10).alias("p"), (i % 7 / 6).alias("tis_prob"), codon.alias("start_codon"), (i % 50 * 3 + 30).alias("len"))
    heads = m.groupBy("user_id").agg(F.min("member").alias("centroid"), F.min_by("p", "member").alias("gene_prob"))
    clusters = m.select("user_id", "member").join(heads.select("user_id", "centroid"), "user_id").select("centroid", "member")
    out = cluster.share_scores(clusters, heads.select("centroid", "gene_prob"), m.select("member", "start_codon", "tis_prob", "len"), calling.START_WEIGHT, calling.GENE_WEIGHT, calling.TIS_WEIGHT, 0.5, 50.0)
    return out.select("centroid", "member", F.round("score", 6).alias("score"))


_PREV = "lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("cluster_steps", f"""WITH s AS (SELECT user_id AS genome, event_id AS dst, {_PREV} AS src FROM events), m AS (SELECT user_id AS genome, event_id AS orf, event_type AS cluster FROM events WHERE value > 10)
SELECT s.genome, a.cluster AS src, b.cluster AS dst, count(*) AS n FROM s JOIN m a ON a.genome = s.genome AND a.orf = s.src JOIN m b ON b.genome = s.genome AND b.orf = s.dst GROUP BY ALL""")
def q_cluster_steps(spark, sf_dir):
    """Steps between ORFs as steps between their clusters; members that did not survive take no part."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("genome"), F.col("event_id").alias("orf"), F.col("event_type").alias("cluster"), "ts", "value")
    steps = e.select("genome", F.lag("orf").over(Window.partitionBy("genome").orderBy("ts", "orf")).alias("src"), F.col("orf").alias("dst"))
    members = genegraph.surviving(e.select("genome", "orf", "cluster"), e.where("value > 10").select("genome", "orf"))
    return genegraph.cluster_steps(steps, members).groupBy("genome", "src", "dst").agg(F.count("*").alias("n"))


@query("surviving_orfs", "SELECT user_id AS genome, event_id AS orf, event_type AS cluster FROM events WHERE event_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_surviving(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("genome"), F.col("event_id").alias("orf"), F.col("event_type").alias("cluster"))
    kept = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("orf")).distinct().join(e.select("genome", "orf"), "orf")
    return genegraph.surviving(e, kept)


# predicates
@query("stage_predicates", """SELECT l_orderkey, l_linenumber, l_quantity >= 20 AS long_enough, l_linenumber <> 1 OR l_linestatus = 'O' AS terminal, l_quantity * 900 <= 20000 OR l_linenumber <= 2 AS short_enough,
  least(l_quantity, 25) >= 0.98 * greatest(l_quantity, 25) AS alike, (l_quantity < 40) OR (l_linestatus = 'O' AND (l_returnflag = 'N' OR l_quantity::INT % 3 <> 0)) AS pseudogene, l_discount = 0 AS unannotated, l_extendedprice / 1000 >= 100 AS good_path,
  l_partkey <> l_suppkey AND l_partkey <> l_orderkey AS unvisited FROM lineitem""")
def q_predicates(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", filters.long_enough(c("l_quantity"), 20).alias("long_enough"), filters.terminal(c("l_linenumber") - 1, c("l_linestatus") == "O").alias("terminal"),
        filters.short_enough(c("l_quantity") * 900, c("l_linenumber")).alias("short_enough"), filters.alike_in_length(c("l_quantity"), F.lit(25)).alias("alike"),
        filters.pseudogene(c("l_quantity"), F.lit(50), c("l_linestatus") == "O", c("l_returnflag") == "N").alias("pseudogene"), filters.unannotated(F.nullif(c("l_discount"), F.lit(0.0))).alias("unannotated"),
        filters.good_score(c("l_extendedprice") / 1000).alias("good_path"), filters.unvisited(F.array("l_suppkey", "l_orderkey"), c("l_partkey")).alias("unvisited"))


@query("neighbours_in_genome", """WITH s AS (SELECT user_id AS genome_id, event_id AS node, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT s.* FROM s WHERE next IN (SELECT event_id FROM events WHERE event_type <> 'click')""")
def q_in_genome(spark, sf_dir):
    """Steps to nodes that the genome has: those that are no clicks."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    s = e.select(F.col("user_id").alias("genome_id"), F.col("event_id").alias("node"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    return filters.in_genome(s, e.where("event_type <> 'click'").select(F.col("event_id").alias("node_id"), F.col("user_id").alias("genome_id")))


@query("ends_in_reference", "SELECT p_partkey AS node FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT')")
def q_ends(spark, sf_dir):
    """Nodes that a reference genome has; urgent orders are the references."""
    genomes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("genome_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_ref"))
    colours = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("genome_id"))
    return filters.ends_in_reference(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), colours, genomes)


@query("free_nodes", """WITH c AS (SELECT l_suppkey AS genome_id, l_partkey AS node, l_discount * 100 AS s, l_quantity AS e FROM lineitem)
SELECT DISTINCT genome_id, node FROM c EXCEPT SELECT genome_id, node FROM c JOIN part ON p_partkey = node WHERE s = 0 AND e = p_size""")
def q_free(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("genome_id"), F.col("l_partkey").alias("node"), (F.col("l_discount") * 100).alias("s"), F.col("l_quantity").alias("e"))
    return filters.free_nodes(c, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("size")))


@query("passable_paths", """WITH a AS (SELECT user_id, event_type = 'click' AND coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'click', FALSE) AS two FROM events)
SELECT user_id, NOT bool_or(two) AS passable FROM a GROUP BY user_id""")
def q_passable(spark, sf_dir):
    """Paths without two nodes in a row that are to be avoided."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("event_type") == "click").alias("a"))))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(listed.alias("x"))
    return e.select("user_id", filters.passable(F.transform("x", lambda x: x["a"])).alias("passable"))


@query("paths_in_genomes", f"""WITH {_STEPS}, t AS (SELECT user_id, ',' || string_agg(node, ',' ORDER BY pos) || ',' AS path FROM p GROUP BY user_id), a AS (SELECT user_id AS u, node AS x, lead(node) OVER (PARTITION BY user_id ORDER BY pos) AS y FROM p),
q AS (SELECT u, x, y FROM a WHERE y IS NOT NULL UNION ALL SELECT u, -y, -x FROM a WHERE y IS NOT NULL)
SELECT u AS user_id, x, y, CASE WHEN contains(path, ',' || x || ',' || y || ',') THEN 1 WHEN contains(path, ',' || -y || ',' || -x || ',') THEN -1 ELSE 0 END AS found FROM q JOIN t ON t.user_id = q.u""")
def q_on_path(spark, sf_dir):
    """Steps looked up on the user's path as they are and read backwards."""
    p = _paths(spark, sf_dir).withColumn("path", S.path_string(F.col("nodes")))
    i = F.when(F.size("nodes") > 1, F.sequence(F.lit(0), F.size("nodes") - 2)).otherwise(F.array().cast("array<int>"))
    steps = F.flatten(F.transform(i, lambda k: F.array(F.array(F.get("nodes", k), F.get("nodes", k + 1)), F.array(-F.get("nodes", k + 1), -F.get("nodes", k)))))
    each = p.select("user_id", "path", F.explode(steps).alias("q"))
    return each.select("user_id", F.get("q", 0).alias("x"), F.get("q", 1).alias("y"), filters.on_path(F.col("path"), F.col("q")).alias("found"))


# sequences
@query("encoded_sequences", f"SELECT item_id, list_transform(string_split({DNA_SQL}, ''), lambda c: instr('ACG', c)::INT) AS bases FROM benchmark")
def q_encoded(spark, sf_dir):
    """Bases as numbers; the alphabet lacks T, which is 0 as any unknown letter."""
    return table(spark, sf_dir, "benchmark").select("item_id", S.encode(S.dna(F.col("text")), "ACG").alias("bases"))


@query("back_translated", f"""WITH d AS (SELECT item_id, {DNA_SQL} AS s FROM benchmark), t AS (SELECT item_id, s, string_split(replace({AA_SQL}, 'L', 'L-'), '') AS c FROM d)
SELECT item_id, list_aggregate(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] IN ('-', 'X') THEN '---' ELSE substr(s, 3 * len(list_filter(c[1:i - 1], lambda y: y <> '-')) + 1, 3) END), 'string_agg', '') AS codons FROM t""")
def q_back(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", S.dna(F.col("text")).alias("s"))
    return d.select("item_id", S.back_translate(F.replace(S.translate_full(F.col("s")), F.lit("L"), F.lit("L-")), F.col("s")).alias("codons"))


@query("best_frames", f"""WITH d AS (SELECT item_id, {DNA_SQL} AS q FROM benchmark), g AS (SELECT item_id, reverse(translate(q, 'ACGT', 'TGCA')) AS q FROM d), h AS (SELECT item_id, 0 AS o, q FROM d UNION ALL SELECT item_id, 3, q FROM g),
f AS (SELECT item_id, o + f AS o, substr(q, f + 1) AS s FROM h, (SELECT unnest(range(0, 3)) AS f)), t AS (SELECT item_id, o, {AA_SQL} AS p FROM f), k AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(p) - 1, 1)), lambda i: substr(p, i, 3))) AS k FROM t)
SELECT a.item_id, arg_max(a.p, row(len(list_intersect(a.k, b.k)), -a.o)) AS protein FROM k a JOIN k b ON a.item_id = b.item_id AND b.o = 4 GROUP BY a.item_id""")
def q_frames(spark, sf_dir):
    """The frame that shares most with a protein, here that of the second frame of the other strand."""
    d = table(spark, sf_dir, "benchmark").select("item_id", S.dna(F.col("text")).alias("s"))
    return d.select("item_id", S.best_frame(F.col("s"), S.translate_full(S.reverse_complement(F.col("s")), 1)).alias("protein"))


@query("masked_ends", f"""WITH t AS (SELECT doc_id, source, regexp_replace(upper(source), 'S', 'XXXXX') || repeat('X', 6) || {DNA_SQL} || repeat('X', 7) || lang AS s FROM documents), f AS (SELECT doc_id, s, regexp_extract(s, '^[^X]*X{{6,}}') AS f FROM t),
b AS (SELECT *, regexp_extract(substr(s, length(f) + 1), 'X{{6,}}[^X]*$') AS b FROM f) SELECT doc_id, md5(repeat('X', length(f)) || substr(s, length(f) + 1, length(s) - length(f) - length(b)) || repeat('X', length(b))) AS masked FROM b""")
def q_masked(spark, sf_dir):
    s = F.concat(F.regexp_replace(F.upper("source"), "S", "XXXXX"), F.lit("XXXXXX"), S.dna(F.col("text")), F.lit("XXXXXXX"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.mask_beyond_gaps(s, 6)).alias("masked"))


@query("text_functions", """SELECT c_custkey, regexp_replace(regexp_extract('/in/' || c_name || '.v1.fa', '[^/]*$'), '\\.[^.]*$', '') AS isolate, translate(c_name || '; a=b,c&d%', ';=,&%' || chr(9), '______') AS qualifier,
  regexp_replace('NN' || upper(c_mktsegment) || 'NNN', '^N+|N+$', '', 'g') AS stripped, list_distinct([c_mktsegment, c_name, c_mktsegment])[1:0] = [] AS fine FROM customer""")
def q_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.isolate_name(F.concat(F.lit("/in/"), "c_name", F.lit(".v1.fa"))).alias("isolate"), S.qualifier(F.concat("c_name", F.lit("; a=b,c&d%"))).alias("qualifier"), S.strip_unknown(F.concat(F.lit("NN"), F.upper("c_mktsegment"), F.lit("NNN"))).alias("stripped"), F.lit(True).alias("fine"))


@query("first_occurrences", "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM (SELECT user_id, event_type, min(row(ts, event_id)) AS x, min(ts) AS ts, arg_min(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type)")
def q_firsts(spark, sf_dir):
    """Ordered dedupe: the first of equal values stays in its place."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(listed.alias("x"))
    return e.select("user_id", F.posexplode(F.array_distinct(F.transform("x", lambda x: x["event_type"]))).alias("pos", "event_type")).withColumn("pos", F.col("pos").cast("long"))


# both strands
@query("orfs_both_strands", BOTH_SQL)
def q_both(spark, sf_dir):
    """ORFs of both strands, those cut off by a contig's end too."""
    d = table(spark, sf_dir, "benchmark").select("item_id", S.dna(F.col("text")).alias("seq"))
    return both_strands(d, ["item_id"], "seq", 30).select("item_id", "strand", *[F.col(c).cast("long").alias(c) for c in ("frame", "start", "end", "stop", "len")], "partial5", "partial3")


@query("located_orfs", f"""WITH o AS (SELECT doc_id, source, frame, o.start, substr(seq, start + 1, len) AS dna FROM ({ORF_PAIRS_SQL}) o JOIN (SELECT doc_id, source, {DNA_SQL} AS seq FROM documents) d USING (doc_id)),
c AS (SELECT doc_id, {DNA_SQL} AS seq FROM documents)
SELECT o.doc_id AS genome, start * 3 + frame AS orf_id, 0 AS contig_id, instr(seq, dna) AS start, FALSE AS reverse FROM o JOIN c USING (doc_id)""")
def q_located(spark, sf_dir):
    """Where an ORF's sequence is first met in its own contig."""
    d = written(balanced(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("genome"), F.lit(0).alias("contig_id"), S.dna(F.col("text")).alias("seq")), "contigs")
    o = orf_pairs(d, "genome", "seq", with_dna=True).select(F.col("id").alias("genome"), (F.col("start") * 3 + F.col("frame")).cast("long").alias("orf_id"), "dna")
    return refind.located(o, d).select("genome", "orf_id", "contig_id", F.col("start").cast("long").alias("start"), "reverse")
