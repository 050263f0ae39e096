"""Queries on the remaining operators: graph building, start choice, names, merging, variants, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import calling, dbg, families, genegraph, kmer, matrix, refind
from strandloom.operators.orf import orf_pairs
from strandloom.plans.graph_queries import LONGEST_SQL, longest_orfs, STEPS_SQL, word_edges
from strandloom.plans.matrix_queries import word_pairs
from strandloom.plans.orf_queries import DNA_SQL, ORF_PAIRS_SQL
from strandloom.plans.registry import query
from strandloom.session import balanced, table, written
from strandloom.sources.tables import variants

K = 15


def _contigs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("genome_id"), F.lit(0).alias("contig_id"), S.dna(F.col("text")).alias("seq"))


@query("kmer_links", f"""
WITH s AS (SELECT item_id, {DNA_SQL} AS seq FROM benchmark), p AS (SELECT item_id, i, substr(seq, i, {K}) AS x FROM (SELECT *, unnest(range(1, greatest(length(seq) - {K - 2}, 1))) AS i FROM s)),
c AS (SELECT item_id, i, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, CASE WHEN x <= reverse(translate(x, 'ACGT', 'TGCA')) THEN 1 ELSE -1 END AS strand FROM p),
l AS (SELECT a.kmer, a.strand AS side, b.kmer AS other, -b.strand AS other_side FROM c a JOIN c b ON a.item_id = b.item_id AND b.i = a.i + 1)
SELECT kmer, side, other, other_side FROM l UNION SELECT other, other_side, kmer, side FROM l""")
def q_links(spark, sf_dir):
    return dbg.sides(dbg.placed_kmers(dbg.pieces(_contigs(spark, sf_dir)), K))


@query("unitigs")
def q_unitigs(spark, sf_dir):
    placed = written(dbg.placed_kmers(dbg.pieces(_contigs(spark, sf_dir)), K), "placed")
    return dbg.unitig_table(dbg.unitigs(placed), K).select("node_id", "seq", "size")


@query("genome_paths")
def q_genome_paths(spark, sf_dir):
    placed = written(dbg.placed_kmers(dbg.pieces(_contigs(spark, sf_dir)), K), "placed")
    members = written(dbg.unitigs(placed), "members")
    return dbg.genome_paths(placed, members, dbg.unitig_table(members, K))


@query("kmer_colours", f"""
WITH s AS (SELECT item_id, {DNA_SQL} AS seq FROM benchmark), p AS (SELECT item_id, substr(seq, unnest(range(1, greatest(length(seq) - {K - 2}, 1))), {K}) AS x FROM s)
SELECT least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, count(DISTINCT item_id) AS n_genomes FROM p GROUP BY 1""")
def q_colours(spark, sf_dir):
    return dbg.colours(dbg.placed_kmers(dbg.pieces(_contigs(spark, sf_dir)), K)).groupBy("kmer").agg(F.count("*").alias("n_genomes"))


@query("connect_orfs", f"""WITH {LONGEST_SQL}, x AS (SELECT doc_id, orf AS src, stop_end, lead(orf) OVER w AS dst, lead(start) OVER w AS s2 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop_end, orf))
SELECT doc_id, src, dst FROM x WHERE dst IS NOT NULL AND s2 - stop_end <= 1000""")
def q_connect(spark, sf_dir):
    o = longest_orfs(spark, sf_dir).select(F.col("key").alias("genome"), F.lit(0).alias("contig_id"), "orf", "start", F.col("stop_end").alias("end"))
    return families.connect_orfs(o, 1000).withColumnRenamed("genome", "doc_id")


def _cut_orfs(spark, sf_dir):
    d = balanced(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(F.struct("doc_id", "source").alias("k"), "text")
    return orf_pairs(d, "k", "text", with_dna=True, prose=True).select("id.doc_id", "id.source", "frame", "stop", "start", "len", "dna")


@query("distinct_orfs", f"""
WITH d AS (SELECT doc_id, source, {DNA_SQL} AS seq FROM documents), c AS (SELECT source, doc_id * 100000 + start AS orf_id, len, substr(seq, start + 1, len) AS dna FROM ({ORF_PAIRS_SQL}) o JOIN d USING (doc_id))
SELECT source, md5(dna) AS dna_md5, min(orf_id) AS orf_id FROM c GROUP BY source, dna""")
def q_distinct_orfs(spark, sf_dir):
    o = _cut_orfs(spark, sf_dir).select("source", "dna", (F.col("doc_id") * 100000 + F.col("start")).alias("orf_id"), F.lit(1).alias("n_nodes"))
    return calling.without_copies(o, "source", "dna", "n_nodes").select("source", F.md5("dna").alias("dna_md5"), "orf_id")


@query("start_choice")
def q_start_choice(spark, sf_dir):
    """One start a stop: votes are genomes at the site, a start-site probability (0.5 without a model), times chosen."""
    o = _cut_orfs(spark, sf_dir).withColumn("site", S.translate_full(F.substr("dna", F.lit(1), F.lit(12))))
    o = written(o.select("doc_id", "source", "frame", "stop", "start", "len", "site"), "starts")
    counts = kmer.genome_counts(o, "source", "site").withColumnRenamed("n_genomes", "site_genomes")
    starts = o.join(counts, "site").select(F.col("doc_id").alias("id"), "frame", "stop", "start", "len", F.lit(0.5).alias("tis"), "site_genomes", F.lit(3 / 64).alias("stop_freq"), "site")
    return calling.choose_starts(starts).select(F.col("id").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in ("frame", "stop", "start", "len")])


@query("paralogs", "SELECT cluster, max(n) AS copies FROM (SELECT l_partkey AS cluster, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY cluster HAVING max(n) > 1")
def q_paralogs(spark, sf_dir):
    return genegraph.paralogs(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cluster"), F.col("l_suppkey").alias("genome"), F.col("l_orderkey").alias("orf")))


@query("gene_names", """
WITH g AS (SELECT c_custkey AS cluster_id, replace(regexp_replace(c_mktsegment || '~~~' || (c_nationkey::VARCHAR), '[^A-Za-z0-9_~|]', '', 'g'), '|', '-') AS label FROM customer)
SELECT cluster_id, CASE WHEN label = '' OR row_number() OVER (PARTITION BY label ORDER BY cluster_id) > 1 THEN 'group_' || cluster_id ELSE label END AS name FROM g""")
def q_names(spark, sf_dir):
    return matrix.gene_names(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster_id"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("annotations")))


@query("merge_attributes", """
WITH m AS (SELECT l_partkey AS merged, l_suppkey AS genome, l_orderkey * 10 + l_linenumber AS orf, repeat('A', l_quantity::INT) AS seq, l_returnflag AS annotation, l_extendedprice AS bitscore, l_linestatus = 'O' AS has_end FROM lineitem)
SELECT merged, count(DISTINCT genome) AS size, arg_min(orf, row(-length(seq), md5(seq), genome, orf)) AS centroid_orf, max(bitscore) AS bitscore, arg_max(annotation, row(bitscore, annotation)) AS annotation,
  string_agg(DISTINCT annotation, ';' ORDER BY annotation) AS description, bool_or(has_end) AS has_end FROM m GROUP BY merged""")
def q_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    node = F.struct("l_partkey", "l_suppkey")
    nodes = li.select(node.alias("node"), F.col("l_suppkey").alias("genome"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("orf"), F.repeat(F.lit("A"), F.col("l_quantity").cast("int")).alias("seq"), F.col("l_returnflag").alias("annotation"), F.col("l_extendedprice").alias("bitscore"), (F.col("l_linestatus") == "O").alias("has_end"))
    merged = li.select(node.alias("node"), F.col("l_partkey").alias("merged")).distinct()
    out = genegraph.merge_attributes(nodes, merged)
    return out.select("merged", "size", F.col("centroid.orf").alias("centroid_orf"), "bitscore", "annotation", "description", "has_end")


@query("clean_edges", STEPS_SQL + """, s AS (SELECT node, count(DISTINCT source) AS size FROM (SELECT source, unnest(w) AS node FROM w) GROUP BY node),
d AS (SELECT node, count(*) < 2 AS has_end FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node), n AS (SELECT * FROM s JOIN d USING (node))
SELECT u, v, n_genomes FROM e JOIN n a ON a.node = u JOIN n b ON b.node = v WHERE NOT ((a.has_end OR b.has_end) AND n_genomes < 2) AND NOT (n_genomes < 0.2 * least(a.size, b.size) AND n_genomes < 2)""")
def q_clean_edges(spark, sf_dir):
    edges = written(word_edges(spark, sf_dir).select("u", "v", "n_genomes"), "edges")
    nodes = matrix.gene_sizes(word_pairs(spark, sf_dir)).select(F.col("gene").alias("node"), F.col("n_genomes").alias("size")).join(genegraph.degrees(edges).select("node", "has_end"), "node")
    return genegraph.clean_edges(nodes, edges, 2, 0.2).select("u", "v", "n_genomes")


@query("merge_paralogs", """
WITH RECURSIVE c AS (SELECT DISTINCT s_suppkey AS node, s_nationkey AS centroid FROM supplier), e AS (SELECT a.node AS a, b.node AS b FROM c a JOIN c b USING (centroid)),
r(node, m) AS (SELECT node, node FROM c UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.node) SELECT node, min(m) AS merged FROM r GROUP BY node""")
def q_merge_paralogs(spark, sf_dir):
    return genegraph.merge_paralogs(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("centroid")))


@query("alignment_variants", f"""
WITH s AS (SELECT item_id, string_split({DNA_SQL}, '') AS c FROM benchmark), b AS (SELECT item_id, i AS site, c[i] AS base FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM s))
SELECT site, arg_min(base, item_id) AS ref, string_agg(DISTINCT base, '' ORDER BY base) AS bases FROM b GROUP BY site HAVING count(DISTINCT base) > 1""")
def q_variants(spark, sf_dir):
    v = variants(table(spark, sf_dir, "benchmark").select(F.lit(1).alias("gene"), F.col("item_id").alias("id"), S.dna(F.col("text")).alias("seq")))
    return v.select(F.col("site").cast("long").alias("site"), "ref", F.array_join(F.sort_array(F.array_append("alts", F.col("ref"))), "").alias("bases"))


@query("query_postings", """
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS node FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS node FROM documents)
SELECT doc_id, count(DISTINCT item_id) AS n_queries, min(item_id) AS first_query FROM q JOIN d USING (node) GROUP BY doc_id""")
def q_postings(spark, sf_dir):
    """Queries (benchmark passages) that meet a document on a node (a word), through the postings."""
    words = lambda t, c: balanced(table(spark, sf_dir, t).select(c, "text")).select(c, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), 0), lambda w: F.xxhash64(w)))).alias("h"))
    index = words("documents", "doc_id").select(F.col("h").alias("node"), F.lit(0).alias("genome_id"), F.col("doc_id").alias("orf_id"))
    hit = words("benchmark", "item_id").select(F.col("item_id").alias("query_id"), F.col("h").alias("n"))
    met = index.join(hit, F.col("node") == F.col("n")).groupBy("orf_id").agg(F.count_distinct("query_id").alias("n_queries"), F.min("query_id").alias("first_query"))
    return met.withColumnRenamed("orf_id", "doc_id")


@query("infix_identity")
def q_infix(spark, sf_dir):
    """How well each passage found by shared k-mers is contained in the document."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("seq"))
    t = balanced(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq")))
    hits = written(kmer.search(q, t, 24, 0.3), "hits")
    pairs = hits.join(q.withColumnRenamed("seq", "q"), "query_id").join(t.withColumnRenamed("seq", "t"), "id")
    return pairs.select("query_id", F.col("id").alias("doc_id"), refind.infix_identity(F.col("q"), F.col("t"), protein=True).alias("identity"))


@query("power_law")
def q_power_law(spark, sf_dir):
    a, b, err = matrix.power_law(matrix.rarefaction(word_pairs(spark, sf_dir)).where("step > 1"))
    return spark.createDataFrame([(a, b, err, b + err > -1)], "a double, b double, error double, open boolean")


@query("family_merge")
def q_family(spark, sf_dir):
    """Suppliers of like balance that are near each other by orders and ship in no common year."""
    li = table(spark, sf_dir, "lineitem")
    prior = F.lag("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    edges = li.select(F.col("l_suppkey").alias("s"), prior.alias("p")).where("s <> p").select(F.least("s", "p").alias("u"), F.greatest("s", "p").alias("v")).distinct()
    nodes = li.select(F.col("l_suppkey").alias("node"), F.date_format("l_shipdate", "yyyy-MM").alias("genome"))
    s = balanced(table(spark, sf_dir, "supplier")).select("s_suppkey", F.floor(F.col("s_acctbal") / 100).alias("band"), "s_acctbal")
    other = s.select(F.col("s_suppkey").alias("b"), F.col("band").alias("band2"), F.col("s_acctbal").alias("bal2"))
    similar = s.join(other, (F.col("band") == F.col("band2")) & (F.col("s_suppkey") < F.col("b"))).select(F.col("s_suppkey").alias("a"), "b", (1 - F.abs(F.col("s_acctbal") - F.col("bal2")) / 100).alias("identity"))
    return families.collapse_families(nodes, edges, similar, 0.7)


@query("reads_and_refs_kmers", f"""
WITH a AS (SELECT {DNA_SQL} AS s FROM benchmark), b AS (SELECT {DNA_SQL} AS s FROM conversations),
x AS (SELECT substr(s, unnest(range(1, greatest(length(s) - {K - 2}, 1))), {K}) AS x FROM a), y AS (SELECT substr(s, unnest(range(1, greatest(length(s) - {K - 2}, 1))), {K}) AS x FROM b),
r AS (SELECT least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer FROM x), w AS (SELECT least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer FROM y)
SELECT kmer, count(*) AS n FROM (SELECT kmer FROM r UNION ALL SELECT kmer FROM w WHERE kmer IN (SELECT kmer FROM w GROUP BY kmer HAVING count(*) >= 2)) GROUP BY kmer""")
def q_reads(spark, sf_dir):
    """K-mers of assemblies (passages) and of reads (turns of conversations), of these only what was seen twice."""
    texts = lambda t: balanced(table(spark, sf_dir, t).select("text")).select(F.col("text").alias("seq"))
    return dbg.counts_of(texts("benchmark"), texts("conversations"), K, prose=True)


@query("gene_presence")
def q_gene_presence(spark, sf_dir):
    """The whole workflow: documents are contigs, their sources genomes; which gene is in which genome."""
    from strandloom import workflow

    d = balanced(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn("source", F.coalesce("source", F.lit("")))
    named = written(dbg.dense_ids(d.select("source").distinct(), "source", "genome_id"), "sources")
    contigs = d.join(F.broadcast(named) if named.count() <= 100_000 else named, "source").select("genome_id", F.col("doc_id").alias("contig_id"), S.dna(F.col("text")).alias("seq"))
    return workflow.run(contigs, workflow.Settings(len_cutoff=0.9, identity=0.9, find_missing=False))["presence"]
