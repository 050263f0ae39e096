"""Queries on the unitig index and on walks through the graph; passages of ``benchmark`` are genomes of a contig each."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import alignpaths, dbg, outward, overlapgraph, traversal
from strandloom.operators.bestpath import PENALTY
from strandloom.plans.more_queries import K as LONG_K
from strandloom.plans.more_queries import _contigs
from strandloom.plans.orf_queries import DNA_SQL
from strandloom.plans.path_queries import _graph
from strandloom.plans.registry import query
from strandloom.session import written


#: Short k-mers recur by chance, so the graph of a few passages has branches, bubbles and repeats.
K = 9


def indexed(spark, sf_dir):
    """(nodes, paths, index, named genomes, how many); genomes are numbered from 0 in the order of their ids' hashes."""
    contigs = _contigs(spark, sf_dir)
    named = written(dbg.dense_ids(contigs.select("genome_id").distinct(), "genome_id", "g").withColumn("g", F.col("g") - 1), "genomes")
    own = contigs.join(named, "genome_id").select(F.col("g").alias("genome_id"), "contig_id", "seq")
    placed = written(dbg.placed_kmers(dbg.pieces(own), K), "placed")
    members = written(dbg.unitigs(placed), "members")
    nodes = written(dbg.unitig_table(members, K), "unitigs")
    paths = written(dbg.genome_paths(placed, members, nodes), "paths")
    n = named.count()
    return nodes, paths, written(traversal.unitig_index(nodes, members, placed, paths, K, n), "index"), named, n


def spelled(nodes):
    """(node, seq) of both reading directions."""
    return nodes.select(F.col("node_id").alias("node"), "seq").unionByName(nodes.select((-F.col("node_id")).alias("node"), S.reverse_complement(F.col("seq")).alias("seq")))


# oriented unitigs n (seq, first and last k-mer with strand), by following links that are the only ones of both their ends
_CODONS = "list_filter(range(0, greatest(length(seq) - 2, 0)), lambda i: substr(seq, (i + 1)::INT, 3) IN ('TAA', 'TGA', 'TAG'))"
_MASK = lambda p, by: f"(list_contains(list_transform({p}, lambda i: (i - {by}) % 3), 0)::INT + 2 * list_contains(list_transform({p}, lambda i: (i - {by}) % 3), 1)::INT + 4 * list_contains(list_transform({p}, lambda i: (i - {by}) % 3), 2)::INT)"
_READ = lambda k, d: f"(CASE WHEN {d} = 1 THEN {k} ELSE reverse(translate({k}, 'ACGT', 'TGCA')) END)"
INDEX_SQL = f"""WITH RECURSIVE s AS (SELECT item_id, {DNA_SQL} AS seq FROM benchmark), p AS (SELECT item_id, i, substr(seq, i, {K}) AS x FROM (SELECT *, unnest(range(1, greatest(length(seq) - {K - 2}, 1))) AS i FROM s)),
c AS (SELECT item_id, i, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, CASE WHEN x <= reverse(translate(x, 'ACGT', 'TGCA')) THEN 1 ELSE -1 END AS strand FROM p),
l AS (SELECT a.item_id, a.kmer, a.strand AS side, b.kmer AS other, -b.strand AS other_side FROM c a JOIN c b ON a.item_id = b.item_id AND b.i = a.i + 1),
u AS (SELECT kmer, side, other, other_side FROM l UNION SELECT other, other_side, kmer, side FROM l), o AS (SELECT kmer, side FROM u GROUP BY ALL HAVING count(*) = 1),
inn AS (SELECT u.* FROM u JOIN o USING (kmer, side) JOIN o q ON q.kmer = u.other AND q.side = u.other_side WHERE u.kmer <> u.other),
d AS (SELECT kmer, unnest([1, -1]) AS dir FROM (SELECT DISTINCT kmer FROM c)),
walk AS (SELECT kmer AS h, dir AS hd, kmer, dir, {_READ('kmer', 'dir')} AS seq FROM d WHERE NOT EXISTS (SELECT 1 FROM inn WHERE inn.other = d.kmer AND inn.other_side = -d.dir)
UNION ALL SELECT h, hd, inn.other, -inn.other_side, seq || right({_READ('inn.other', '(-inn.other_side)')}, 1) FROM walk JOIN inn ON inn.kmer = walk.kmer AND inn.side = walk.dir),
n AS (SELECT h, hd, kmer AS t, dir AS td, seq, length(seq) AS size FROM walk WHERE NOT EXISTS (SELECT 1 FROM inn WHERE inn.kmer = walk.kmer AND inn.side = walk.dir)),
m AS (SELECT h, hd, t, td, seq, size, len({_CODONS}) AS n_stops, {_MASK(_CODONS, 0)} AS stops, {_MASK(f'list_filter({_CODONS}, lambda j: j >= {K - 3})', K - 3)} AS entering FROM n),
g AS (SELECT DISTINCT m.seq, c.item_id FROM m JOIN c ON c.kmer = m.h OR c.kmer = m.t),
e AS (SELECT DISTINCT m.seq, c.item_id FROM (SELECT item_id, min(i) AS a, max(i) AS b FROM c GROUP BY item_id) x JOIN c ON c.item_id = x.item_id AND c.i IN (x.a, x.b) JOIN walk w ON w.kmer = c.kmer JOIN m ON m.h = w.h AND m.hd = w.hd)"""


@query("unitig_index", INDEX_SQL + """ SELECT seq, size, n_stops, stops, entering, coalesce(a.n, 0) AS n_genomes, coalesce(b.n, 0) AS n_ends FROM m
LEFT JOIN (SELECT seq, count(*) AS n FROM g GROUP BY seq) a USING (seq) LEFT JOIN (SELECT seq, count(*) AS n FROM e GROUP BY seq) b USING (seq)""")
def q_unitig_index(spark, sf_dir):
    """Both readings of every unitig with their stop masks, and how many genomes have them and begin or end there."""
    nodes, _, index, _, _ = indexed(spark, sf_dir)
    n = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    return index.join(spelled(nodes), "node").select("seq", F.col("size").cast("long").alias("size"), F.col("n_stops").cast("long").alias("n_stops"), "stops", "entering", n(F.col("colours")).alias("n_genomes"), n(F.col("ends")).alias("n_ends"))


_TURN = "(((b.entering << ((pw.size - 2) % 3)::INT) | (b.entering >> (3 - (pw.size - 2) % 3)::INT)) & 7)"


@query("stop_paths", INDEX_SQL + f""",
st AS (SELECT DISTINCT x.item_id, a.seq AS v, b.seq AS w FROM (SELECT item_id, kmer, side, other, -other_side AS od FROM l UNION ALL SELECT item_id, other, other_side, kmer, -side FROM l) x JOIN n a ON a.t = x.kmer AND a.td = x.side JOIN n b ON b.h = x.other AND b.hd = x.od),
pw AS (SELECT y.item_id, [m.seq] AS path, m.seq AS v, m.size, CASE WHEN e.seq IS NOT NULL THEN 7 ELSE m.stops END AS open, false AS ready, true AS goes
  FROM (SELECT * FROM g UNION SELECT * FROM e) y JOIN m USING (seq) LEFT JOIN e ON e.seq = y.seq AND e.item_id = y.item_id WHERE e.seq IS NOT NULL OR m.stops <> 0
UNION ALL SELECT item_id, path, v, size, open, CASE WHEN size > 20000 THEN len(path) = 2 ELSE open = 0 OR at_end END, size <= 20000 AND open <> 0 FROM (
  SELECT pw.item_id, list_append(pw.path, b.seq) AS path, b.seq AS v, pw.size + b.size - {K - 1} AS size, pw.open & ~{_TURN} AS open, e.seq IS NOT NULL AS at_end
  FROM pw JOIN st ON st.item_id = pw.item_id AND st.v = pw.v JOIN m b ON b.seq = st.w LEFT JOIN e ON e.seq = b.seq AND e.item_id = pw.item_id WHERE pw.goes AND NOT list_contains(pw.path, b.seq)) z)
SELECT item_id, md5(array_to_string(path, ',')) AS path_md5, len(path) AS n_nodes, size, open FROM pw WHERE ready""")
def q_stop_paths(spark, sf_dir):
    """Walks from stop to stop, or to the ends of contigs, along the steps that each genome takes."""
    nodes, paths, index, named, n = indexed(spark, sf_dir)
    found = traversal.stop_paths(index, traversal.graph_steps(index, paths, n, True), K)
    walks = written(found.select(F.posexplode("path").alias("at", "node"), "path").distinct().join(spelled(nodes), "node").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("s")), "walks")
    of = walks.select("path", F.md5(F.array_join(F.transform("s", lambda x: x["seq"]), ",")).alias("path_md5"), (F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x["seq"])) - (F.size("s") - 1) * (K - 1)).cast("long").alias("size"))
    each = found.select("path", "open", F.explode(traversal.bits(F.col("genomes"))).alias("g")).join(named, "g").join(of, "path")
    return each.select(F.col("genome_id").alias("item_id"), "path_md5", F.size("path").cast("long").alias("n_nodes"), "size", "open")


_SIDE = lambda s, e, d: f"CASE WHEN {s} >= lo AND {e} <= hi THEN 53 WHEN {s} >= lo THEN CASE WHEN {d} > 0 THEN 5 ELSE 3 END WHEN {e} <= hi THEN CASE WHEN {d} > 0 THEN 3 ELSE 5 END ELSE 0 END"


@query("path_overlaps", f"""WITH s AS (SELECT item_id, length({DNA_SQL}) AS n FROM benchmark), i AS (SELECT item_id, n, unnest(range(0, n // 20)) AS orf FROM s),
w AS (SELECT item_id, orf, 20 * orf AS s, 20 * orf + 40 + 17 * (orf % 4) AS e, CASE WHEN orf % 3 = 0 THEN -1 ELSE 1 END AS d FROM i WHERE 20 * orf + 40 + 17 * (orf % 4) <= n),
p AS (SELECT a.item_id, a.orf AS src, b.orf AS dst, a.s, a.e, a.d, b.s AS s2, b.e AS e2, b.d AS d2, greatest(a.s, b.s) AS lo, least(a.e, b.e) AS hi FROM w a JOIN w b ON a.item_id = b.item_id AND a.orf < b.orf AND b.s < a.e),
t AS (SELECT *, hi - lo AS bp, {_SIDE('s', 'e', 'd')} AS x, {_SIDE('s2', 'e2', 'd2')} AS y FROM p)
SELECT item_id, src, dst, CASE WHEN bp > 60 THEN 'i' WHEN x = 53 OR y = 53 THEN 'w' WHEN x = 3 AND y = 3 THEN 'c' WHEN x = 5 AND y = 5 THEN 'd' ELSE 'u' END AS type, bp FROM t""")
def q_path_overlaps(spark, sf_dir):
    """How stretches of passages overlap, told from their paths through the graph alone; SQL has their coordinates."""
    out = alignpaths.path_overlaps(_stretch_paths(spark, sf_dir), LONG_K)
    return out.select(F.col("key").alias("item_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "type", "bp")


def _stretch_paths(spark, sf_dir):
    """(key, orf, strand, path): overlapping stretches of the passages as paths of nodes."""
    placed, members, nodes = _graph(spark, sf_dir)
    steps = written(dbg.genome_paths(placed, members, nodes), "paths")
    contigs = _contigs(spark, sf_dir)
    at = F.explode(F.when(F.length("seq") >= 20, F.sequence(F.lit(0), F.floor(F.length("seq") / 20).cast("int") - 1))).alias("orf")
    w = contigs.select("genome_id", "contig_id", F.lit(0).alias("piece"), F.length("seq").alias("n"), at).withColumn("start", 20 * F.col("orf"))
    w = written(w.withColumn("end", F.col("start") + 40 + 17 * (F.col("orf") % 4)).where("end <= n").withColumn("strand", F.when(F.col("orf") % 3 == 0, -1).otherwise(1)).drop("n"), "stretches")
    keys = ["genome_id", "contig_id", "piece", "start", "end"]
    lifted = alignpaths.sized(dbg.lift(w, steps).join(w, keys).select(F.col("genome_id").alias("key"), "orf", "strand", "coords"), nodes, ["key", "orf"])
    return written(lifted.withColumn("path", F.when(F.col("strand") < 0, alignpaths.turned(F.col("path"))).otherwise(F.col("path"))), "stretch-paths")


# a stretch's best total from those of all before it: each later stretch of a passage can be reached from each earlier one
_BP = "(least(ee[i], ee[j]) - ss[j])"
_COST = f"""CASE WHEN {_BP} <= 0 THEN 0 WHEN {_BP} > 60 THEN NULL WHEN ee[j] <= ee[i] THEN 0 WHEN dd[i] > 0 AND dd[j] < 0 THEN {PENALTY['c']!r} * {_BP} WHEN dd[i] < 0 AND dd[j] > 0 THEN {PENALTY['d']!r} * {_BP} ELSE {PENALTY['u']!r} * {_BP} END"""


@query("overlap_graph_paths", f"""WITH RECURSIVE s AS (SELECT item_id, length({DNA_SQL}) AS n FROM benchmark), i AS (SELECT item_id, n, unnest(range(0, n // 20)) AS orf FROM s),
w AS (SELECT item_id, orf, 20 * orf AS s, 20 * orf + 40 + 17 * (orf % 4) AS e, CASE WHEN orf % 3 = 0 THEN -1 ELSE 1 END AS d, ((orf * 37) % 23 * 10 - 40)::DOUBLE AS x FROM i WHERE 20 * orf + 40 + 17 * (orf % 4) <= n),
g AS (SELECT item_id, count(*) AS n, list(s ORDER BY orf) AS ss, list(e ORDER BY orf) AS ee, list(d ORDER BY orf) AS dd, list(x ORDER BY orf) AS xx FROM w GROUP BY item_id),
r AS (SELECT item_id, 1 AS j, [xx[1]] AS b FROM g UNION ALL
SELECT g.item_id, h.j, list_append(r.b, g.xx[h.j] + greatest(0, coalesce(list_max(list_transform(range(1, h.j), lambda i: r.b[i] - {_COST.replace('ee[', 'g.ee[').replace('ss[', 'g.ss[').replace('dd[', 'g.dd[').replace('[j]', '[h.j]')})), 0))) FROM r JOIN g USING (item_id) CROSS JOIN LATERAL (SELECT r.j + 1 AS j) h WHERE r.j < g.n)
SELECT item_id, round(list_max(b), 6) AS total FROM r JOIN g USING (item_id) WHERE j = n AND list_max(b) >= 100""")
def q_overlap_graph_paths(spark, sf_dir):
    """What the best chain of stretches of each passage scores, over the overlaps that the graph shows."""
    stretches = _stretch_paths(spark, sf_dir)
    found = written(alignpaths.path_overlaps(stretches, LONG_K), "overlaps")
    scored = stretches.select("key", F.col("orf").cast("long").alias("orf"), ((F.col("orf") * 37) % 23 * 10 - 40).cast("double").alias("score"))
    out = overlapgraph.best_gene_paths(scored, found.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")}), 100.0)
    return out.groupBy(F.col("key").alias("item_id")).agg(F.round(F.max("total"), 6).alias("total"))


#: Genes of the passages: stretches of 30, 37 or 44 bases, one in every 70. They are searched around, and joined over, so many bases.
RADIUS, REACH = 30, 60
_GENES_SQL = f"""gn AS (SELECT item_id, orf, 70 * orf + 5 AS a, 70 * orf + 35 + 7 * (orf % 3) AS b FROM (SELECT item_id, length(seq) AS n, unnest(range(0, length(seq) // 70)) AS orf FROM s) WHERE 70 * orf + 35 + 7 * (orf % 3) <= n),
oc AS (SELECT DISTINCT c.item_id, m.seq AS v, m.size, c.i - 1 - (length(walk.seq) - {K}) AS beg FROM c JOIN walk ON walk.kmer = c.kmer AND walk.dir = c.strand JOIN m ON m.h = walk.h AND m.hd = walk.hd),
st AS (SELECT DISTINCT x.item_id, a.seq AS v, b.seq AS w, b.size FROM (SELECT item_id, kmer, side, other, -other_side AS od FROM l UNION ALL SELECT item_id, other, other_side, kmer, -side FROM l) x JOIN n a ON a.t = x.kmer AND a.td = x.side JOIN n b ON b.h = x.other AND b.hd = x.od),
gp AS (SELECT gn.item_id, gn.orf, v, size, beg, greatest(a - beg, 0) AS lo, least(b - beg, size) AS hi FROM gn JOIN oc ON oc.item_id = gn.item_id AND beg < b AND beg + size > a),
hs AS (SELECT item_id, orf, 1 AS side, x.v AS v, x.lo AS near, x.hi AS far, x.size - x.hi AS spare FROM (SELECT item_id, orf, arg_max({{'v': v, 'lo': lo, 'hi': hi, 'size': size}}, beg) AS x FROM gp GROUP BY ALL)
  UNION ALL SELECT item_id, orf, -1, reverse(translate(x.v, 'ACGT', 'TGCA')), x.size - x.hi, x.size - x.lo, x.lo FROM (SELECT item_id, orf, arg_min({{'v': v, 'lo': lo, 'hi': hi, 'size': size}}, beg) AS x FROM gp GROUP BY ALL))"""


def _genes(spark, sf_dir, nodes, paths, named):
    """(genome_id, gene, path): the genes of the passages."""
    own = _contigs(spark, sf_dir).join(named, "genome_id").select(F.col("g").alias("genome_id"), "contig_id", F.lit(0).alias("piece"), F.length("seq").alias("n"))
    each = own.select("*", F.explode(F.when(F.col("n") >= 70, F.sequence(F.lit(0), F.floor(F.col("n") / 70).cast("int") - 1))).alias("gene")).withColumn("start", 70 * F.col("gene") + 5)
    each = written(each.withColumn("end", F.col("start") + 30 + 7 * (F.col("gene") % 3)).where("end <= n").drop("n").withColumn("gene", F.col("gene").cast("long")), "gene-stretches")
    lifted = dbg.lift(each, paths).join(each, ["genome_id", "contig_id", "piece", "start", "end"])
    return written(alignpaths.sized(lifted.select("genome_id", "gene", "coords"), nodes, ["genome_id", "gene"]), "genes")


@query("outward_walks", INDEX_SQL + f""", {_GENES_SQL},
cv AS (SELECT DISTINCT item_id, v FROM gp WHERE lo = 0 AND hi = size), fu AS (SELECT item_id, v FROM cv UNION SELECT item_id, reverse(translate(v, 'ACGT', 'TGCA')) FROM cv),
sf AS (SELECT st.*, fu.v IS NOT NULL AS taken FROM st LEFT JOIN fu ON fu.item_id = st.item_id AND fu.v = st.w),
pw AS (SELECT item_id, orf, side, [v] AS path, v, spare AS len, false AS past, false AS ended FROM hs
UNION ALL SELECT pw.item_id, orf, side, list_append(path, sf.w), sf.w, len + sf.size - {K - 1}, sf.taken, e.seq IS NOT NULL
  FROM pw JOIN sf ON sf.item_id = pw.item_id AND sf.v = pw.v LEFT JOIN e ON e.item_id = pw.item_id AND e.seq = sf.w WHERE len < {RADIUS} AND NOT list_contains(path, sf.w) AND NOT (past AND sf.taken)),
fr AS (SELECT pw.item_id, orf, side, path, len, past, ended, count(sf.w) AS n_may, count(sf.w) FILTER (NOT sf.taken) AS n_free FROM pw LEFT JOIN sf ON sf.item_id = pw.item_id AND sf.v = pw.v AND NOT list_contains(path, sf.w) GROUP BY ALL)
SELECT * FROM (SELECT item_id, orf, side, md5(array_to_string(path, ',')) AS path_md5, len(path) AS n_nodes, len AS bases, CASE WHEN len >= {RADIUS} THEN 'radius' WHEN ended THEN 'end' WHEN n_may = 0 THEN 'dead' WHEN past AND n_free = 0 THEN 'blocked' END AS why FROM fr) WHERE why IS NOT NULL""")
def q_outward_walks(spark, sf_dir):
    """How passages go on beyond their genes at both sides, by the graph; two nodes in a row that genes take up stop a walk."""
    nodes, paths, index, named, n = indexed(spark, sf_dir)
    walks = written(outward.extend(_genes(spark, sf_dir, nodes, paths, named), traversal.graph_steps(index, paths, n, True), K, n, RADIUS), "walks")
    parts = walks.select("path", F.posexplode("path").alias("at", "node")).distinct().join(spelled(nodes), "node").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("p"))
    named_walks = walks.join(parts.select("path", F.md5(F.array_join(F.transform("p", lambda x: x["seq"]), ",")).alias("path_md5")), "path").join(named, walks["genome_id"] == named["g"])
    return named_walks.select(named["genome_id"].alias("item_id"), F.col("gene").alias("orf"), F.col("side").cast("long").alias("side"), "path_md5", F.size("path").cast("long").alias("n_nodes"), F.col("length").alias("bases"), "why")


@query("graph_connections", INDEX_SQL + f""", {_GENES_SQL},
pl AS (SELECT item_id, orf, v, near, far FROM hs UNION SELECT item_id, orf, reverse(translate(v, 'ACGT', 'TGCA')), length(v) - far, length(v) - near FROM hs),
dn AS (SELECT hs.item_id, hs.orf, hs.side, hs.v, hs.spare, hs.far, min({{'near': pl.near, 'far': pl.far, 'orf': pl.orf}}) FILTER (pl.orf IS NOT NULL) AS x FROM hs LEFT JOIN pl ON pl.item_id = hs.item_id AND pl.v = hs.v AND pl.orf <> hs.orf AND (pl.near, pl.far, pl.orf) > (hs.near, hs.far, hs.orf) GROUP BY ALL),
sg AS (SELECT st.*, EXISTS (SELECT 1 FROM pl WHERE pl.item_id = st.item_id AND pl.v = st.w) AS meets FROM st),
pw AS (SELECT item_id, orf, side, [v] AS path, v, spare AS len, false AS met FROM dn WHERE x IS NULL
UNION ALL SELECT pw.item_id, orf, side, list_append(path, sg.w), sg.w, CASE WHEN sg.meets THEN len ELSE len + sg.size - {K - 1} END, sg.meets
  FROM pw JOIN sg ON sg.item_id = pw.item_id AND sg.v = pw.v WHERE NOT met AND len - {K - 1} <= {REACH} AND NOT list_contains(path, sg.w)),
ar AS (SELECT pw.item_id, pw.orf, pw.side, pw.path, pw.len, min({{'near': pl.near, 'far': pl.far, 'orf': pl.orf}}) AS x FROM pw JOIN pl ON pl.item_id = pw.item_id AND pl.v = pw.v AND pl.orf <> pw.orf WHERE met GROUP BY ALL),
al AS (SELECT item_id, orf, x.orf AS other, x.near - far AS gap FROM dn WHERE x IS NOT NULL UNION ALL SELECT item_id, orf, x.orf, len - {K - 1} + x.near FROM ar)
SELECT item_id, least(orf, other) AS a, greatest(orf, other) AS b, min(gap) AS gap FROM al WHERE gap <= {REACH} GROUP BY ALL""")
def q_graph_connections(spark, sf_dir):
    """Which genes of a passage come next to each other by the graph, and how many bases lie between."""
    nodes, paths, index, named, n = indexed(spark, sf_dir)
    pairs = outward.connections(outward.next_genes(_genes(spark, sf_dir, nodes, paths, named), traversal.graph_steps(index, paths, n, True), K, n, REACH))
    return pairs.join(named, pairs["genome_id"] == named["g"]).select(named["genome_id"].alias("item_id"), "a", "b", "gap")
