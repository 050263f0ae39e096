"""Queries on readers and writers: tables are written by a sink, read back by a source, and must be what they were."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import genegraph, kmer, matrix, orf
from strandloom.plans.graph_queries import LONGEST_SQL, longest_orfs
from strandloom.plans.matrix_queries import PAIRS_SQL, word_pairs
from strandloom.plans.orf_queries import DNA_SQL, ORF_PAIRS_SQL
from strandloom.plans.registry import query
from strandloom.session import balanced, shared_folder, table, written
from strandloom.sources import fasta, saved, tables


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _text(df, name):
    """A column of text in files; returns their folder."""
    path = _place(df.sparkSession, name)
    df.write.text(path)
    return path


_DNA = f"{DNA_SQL} AS seq"


@query("fasta_round_trip", f"SELECT 'doc' || doc_id AS id, source || ' ' || lang AS description, {_DNA} FROM documents WHERE length({DNA_SQL}) > 0")
def q_fasta(spark, sf_dir):
    """FASTA lines, in lower case and broken at 60 bases, read as records."""
    d = balanced(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).withColumn("seq", S.dna(F.col("text"))).where(F.length("seq") > 0)
    broken = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    path = _text(fasta.fasta_lines(d, F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" "), "source", F.lit(" "), "lang"), broken), "fasta")
    return fasta.read_fasta(spark, path).select("id", "description", "seq")


@query("fastq_round_trip", f"SELECT 'item' || item_id AS id, 'q' AS description, {_DNA} FROM benchmark")
def q_fastq(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", S.dna(F.col("text")).alias("seq"))
    lines = b.select(F.concat(F.lit("@item"), F.col("item_id").cast("string"), F.lit(" q\n"), F.lower("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq"))).alias("value"))
    return fasta.read_fasta(spark, _text(lines, "fastq")).select("id", "description", "seq")


@query("path_list", "SELECT (row_number() OVER (ORDER BY source) - 1)::INT AS genome_id, '/in/' || source || '.v2.fa' AS path, source || '.v2' AS isolate, TRUE AS is_ref FROM (SELECT DISTINCT source FROM documents)")
def q_paths(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").coalesce(1)
    return fasta.read_paths(spark, _text(names.select(F.concat(F.lit("/in/"), "source", F.lit(".v2.fa")).alias("value")), "paths"))


@query("query_file", f"SELECT 'q' || item_id AS query_id, {_DNA} FROM benchmark UNION ALL SELECT '0', {_DNA} FROM (SELECT string_agg(text, '') AS text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))")
def q_query_file(spark, sf_dir):
    """Queries as FASTA, and as a sequence a line."""
    b = table(spark, sf_dir, "benchmark").select("item_id", S.dna(F.col("text")).alias("seq"))
    one = fasta.read_queries(spark, _text(fasta.fasta_lines(b, F.concat(F.lit("q"), F.col("item_id").cast("string")), F.col("seq")), "queries"))
    plain = b.agg(F.min_by("seq", "item_id").alias("value")).coalesce(1)
    return one.unionByName(fasta.read_queries(spark, _text(plain, "lines")))


@query("annotation_hits", """WITH h AS (SELECT 'q' || l_partkey AS q, 'h' || l_orderkey || '.' || l_linenumber AS hit, l_quantity AS s FROM lineitem)
SELECT q AS "query", max(s) AS score, arg_max(hit, row(s, hit)) AS hit, count(*) AS n FROM h GROUP BY q""")
def q_hits(spark, sf_dir):
    """Half of the hits as a protein search's table and half as a profile search's; the best of each query."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("q"), F.concat(F.lit("h"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("hit"), F.col("l_quantity").alias("s"), "l_linenumber")
    score = F.col("s").cast("string")
    one = li.where("l_linenumber < 4").select(F.concat_ws("\t", "q", "hit", score, F.lit("some protein")).alias("value"))
    two = li.where("l_linenumber >= 4").select(F.concat_ws("  ", "hit", F.lit("-"), "q", F.lit("-"), F.lit("1e-9"), score, *map(F.lit, ["0.0", "1e-9", "1.0", "0.0", "1.0", "1", "0", "0", "1", "1", "1", "1"]), F.lit("a description of it")).alias("value"))
    head = spark.createDataFrame([("# target name",), ("",)], "value string")
    hits = tables.read_diamond(spark, _text(one, "diamond")).unionByName(tables.read_hmmer(spark, _text(two.unionByName(head), "hmmer")))
    best = genegraph.best_hit(hits.select("query", "hit", "bitscore"), "query", "bitscore", "hit").select("query", "score", F.col("hit.hit").alias("hit"))
    return best.join(hits.groupBy("query").agg(F.count("*").alias("n")), "query")


@query("gfa_round_trip", f"""WITH n AS (SELECT item_id AS node, {DNA_SQL} AS seq FROM benchmark), l AS (SELECT node AS src, lead(node) OVER (ORDER BY node) AS dst FROM n),
c AS (SELECT n_nationkey % (SELECT max(item_id) + 1 FROM benchmark) AS node, string_agg(n_regionkey::VARCHAR, ',' ORDER BY n_regionkey) AS g FROM (SELECT DISTINCT n_nationkey, n_regionkey FROM nation) GROUP BY 1)
SELECT 'S' AS kind, node::VARCHAR AS name, seq AS value, g AS more FROM n LEFT JOIN c USING (node) UNION ALL SELECT 'L', src || '+', dst || '-', '14M' FROM l WHERE dst IS NOT NULL""")
def q_gfa(spark, sf_dir):
    """A coloured graph as GFA: segments with their genomes, links with signs."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), S.dna(F.col("text")).alias("seq"))
    top = n.agg(F.max("node_id")).first()[0] + 1
    colours = tables.graph_colours(table(spark, sf_dir, "nation").select((F.col("n_nationkey") % top).cast("long").alias("node_id"), F.col("n_regionkey").alias("genome_id")))
    nodes = n.join(colours.withColumnRenamed("node", "node_id"), "node_id", "left")
    links = n.select(F.col("node_id").alias("src"), (-F.lead("node_id").over(Window.orderBy("node_id"))).alias("dst")).where("dst IS NOT NULL")  # a row a passage
    # node 0 has no sign of its own
    shifted = links.select((F.col("src") + 1).alias("src"), (F.col("dst") - 1).alias("dst"))
    seg, lin = tables.read_gfa(spark, _text(tables.gfa_lines(nodes, shifted, 14), "gfa"))
    back = lambda c: (F.col(c).cast("long") - 1).cast("string")
    return seg.select(F.lit("S").alias("kind"), "name", F.col("seq").alias("value"), F.array_join("genomes", ",").alias("more")).unionByName(lin.select(F.lit("L").alias("kind"), F.concat(back("src"), "src_strand").alias("name"), F.concat(back("dst"), "dst_strand").alias("value"), F.col("overlap").alias("more")))


@query("gff3_text", f"""WITH {LONGEST_SQL}, l AS (SELECT doc_id, start, stop_end, orf, 'doc' || doc_id || chr(9) || 'strandloom' || chr(9) || 'CDS' || chr(9) || (start + 1) || chr(9) || stop_end || chr(9) || '.' || chr(9) || '+' || chr(9) || '0' || chr(9)
  || 'ID=' || doc_id || '_' || orf || '_x;gene=g_' || orf || ';product=frame_' || frame AS line FROM n)
SELECT 'iso' || doc_id AS isolate, md5('##gff-version 3' || chr(10) || string_agg(line, chr(10) ORDER BY start, stop_end, line)) AS md5 FROM l GROUP BY doc_id""")
def q_gff3(spark, sf_dir):
    """Genes of an isolate in order, with qualifiers cleaned."""
    o = longest_orfs(spark, sf_dir)
    text = lambda *x: F.concat(*[F.col(c).cast("string") if c in o.columns else F.lit(c) for c in x])
    genes = o.select(text("iso", "key").alias("isolate"), text("doc", "key").alias("contig"), (F.col("start") + 1).alias("start"), F.col("stop_end").alias("end"), F.lit("+").alias("strand"), text("key", "_", "orf", ";x").alias("id"), text("g=", "orf").alias("name"), text("frame", ",", "frame").alias("product"))
    genes = genes.withColumn("product", F.concat(F.lit("frame&"), F.element_at(F.split("product", ","), -1)))
    return tables.gff3_lines(genes).select("isolate", F.md5("value").alias("md5"))


@query("gene_fasta_text", """SELECT '>' || c_mktsegment || '_' || c_custkey || ' cluster=' || c_nationkey || CASE WHEN c_nationkey % 2 = 0 THEN ' ' || c_name ELSE '' END || CASE WHEN c_acctbal < 0 THEN '(pseudogene)' ELSE '' END || chr(10) || upper(c_name) AS value FROM customer""")
def q_gene_fasta(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    genes = c.select(F.col("c_mktsegment").alias("isolate"), F.col("c_custkey").alias("orf_id"), F.col("c_nationkey").alias("cluster"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).alias("annotation"), (F.col("c_acctbal") < 0).alias("pseudo"), F.lower("c_name").alias("dna"), F.upper("c_name").alias("protein"))
    return fasta.gene_fasta(genes, protein=True)


@query("query_fasta_text", "SELECT '>' || n_name || '_' || n_nationkey || ' QUERY=' || r_name || ';x annotation=' || chr(10) || upper(n_name) AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
def q_query_fasta(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return fasta.query_fasta(n.select(F.col("n_name").alias("isolate"), F.col("n_nationkey").alias("orf_id"), F.array("r_name", F.lit("x")).alias("queries"), F.lit(None).cast("string").alias("annotation"), F.upper("n_name").alias("dna")))


@query("pangenome_reference", "SELECT min(p_name) AS gene, p_size AS centroid, arg_min(p_type, row(p_name, p_type)) AS dna FROM part GROUP BY p_size")
def q_reference(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("gene"), F.array("p_size", F.lit(99)).alias("centroids"), F.col("p_type").alias("dna"))
    return fasta.pangenome_reference(p)


@query("gml_round_trip", """SELECT 'node' AS kind, s_suppkey::VARCHAR AS a, s_name || ' "x] y"' AS b, s_nationkey::VARCHAR AS c FROM supplier
UNION ALL SELECT 'edge', s_suppkey::VARCHAR, s_nationkey::VARCHAR, '3' FROM supplier""")
def q_gml(spark, sf_dir):
    """A gene graph as GML text and read again."""
    s = table(spark, sf_dir, "supplier")
    text = tables.gml_lines(s.select(F.col("s_suppkey").alias("node"), F.concat("s_name", F.lit(' "x] y"')).alias("label"), F.col("s_nationkey").alias("size")), s.select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("v"), F.lit(3).alias("n_genomes")))
    nodes, edges = tables.read_gml(spark, _text(text.orderBy("part").select("value").coalesce(1), "gml"))
    a = F.col("attributes")
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), a["label"].alias("b"), a["size"].alias("c")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), a["size"].alias("c")))


@query("phylip_text", PAIRS_SQL + """, n AS (SELECT genome, count(*) AS n FROM pairs GROUP BY genome), s AS (SELECT p.genome AS a, q.genome AS b, count(*) AS k FROM pairs p JOIN pairs q USING (gene) GROUP BY ALL),
d AS (SELECT x.genome AS a, y.genome AS b, x.n + y.n - 2 * coalesce(k, 0) AS d FROM n x, n y LEFT JOIN s ON s.a = x.genome AND s.b = y.genome)
SELECT a AS row, a || chr(9) || string_agg(d::VARCHAR, chr(9) ORDER BY b) AS value FROM d GROUP BY a""")
def q_phylip(spark, sf_dir):
    pairs = written(word_pairs(spark, sf_dir), "pairs")
    return tables.phylip_lines(matrix.gene_distances(pairs), pairs.select(F.col("genome").alias("id")).distinct())


_ALN = "x AS (SELECT n_regionkey AS gene, n_nationkey % 4 AS id, rpad(substr(replace(n_name, 'A', '-'), 1, 4 + n_regionkey), 4 + n_regionkey, '-') AS seq FROM nation)"


def _alignments(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    width = F.col("n_regionkey") + 4
    return n.select(F.col("n_regionkey").alias("gene"), (F.col("n_nationkey") % 4).alias("id"), F.rpad(F.substr(F.replace("n_name", F.lit("A"), F.lit("-")), F.lit(1), width), width, F.lit("-")).alias("seq"))


_BEST = f"{_ALN}, b AS (SELECT gene, id, arg_min(seq, row(length(seq) - length(replace(seq, '-', '')), seq)) AS seq FROM x GROUP BY gene, id), g AS (SELECT DISTINCT gene, 4 + gene AS w FROM x), i AS (SELECT DISTINCT id FROM x)"


@query("core_alignment", f"WITH {_BEST} SELECT id, string_agg(coalesce(b.seq, repeat('-', w::INT)), '' ORDER BY gene) AS seq FROM i CROSS JOIN g LEFT JOIN b USING (gene, id) GROUP BY id")
def q_core(spark, sf_dir):
    """The alignments of all genes, one after the other; of several sequences of an isolate the one with fewest gaps."""
    x = _alignments(spark, sf_dir)
    return tables.core_alignment(x, x.select("gene").distinct(), x.select("id"))[0]


@query("embl_header", f"""WITH {_BEST}, p AS (SELECT gene, sum(w) OVER (ORDER BY gene) AS e, w FROM g)
SELECT 1 AS part, 'FT   feature         ' || (e - w + 1) || '..' || e || chr(10) || 'FT                   /label="' || gene || '"' || chr(10) || 'FT                   /locus_tag="' || gene || '"' AS value FROM p""")
def q_embl(spark, sf_dir):
    x = _alignments(spark, sf_dir)
    return tables.embl_header(tables.core_alignment(x, x.select("gene").distinct(), x.select("id"))[1]).where("part = 1")


@query("vcf_text", f"""WITH s AS (SELECT item_id AS id, string_split({DNA_SQL}, '') AS c FROM benchmark), b AS (SELECT id, i AS site, c[i] AS base FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM s)),
v AS (SELECT site, arg_min(base, id) AS ref, list_sort(list(DISTINCT base)) AS bases, list(row(id, base) ORDER BY id) AS calls FROM b GROUP BY site HAVING count(DISTINCT base) > 1),
a AS (SELECT *, list_filter(bases, lambda x: x <> ref) AS alts FROM v)
SELECT site, '1' || chr(9) || site || chr(9) || '.' || chr(9) || ref || chr(9) || array_to_string(alts, ',') || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'GT' || chr(9)
  || array_to_string(list_transform(calls, lambda x: CASE WHEN x[2] = ref THEN '0' ELSE list_position(alts, x[2])::VARCHAR END), chr(9)) AS value FROM a""")
def q_vcf(spark, sf_dir):
    v = tables.variants(table(spark, sf_dir, "benchmark").select(F.lit(1).alias("gene"), F.col("item_id").alias("id"), S.dna(F.col("text")).alias("seq")))
    return tables.vcf_lines(v).select(F.col("site").cast("long").alias("site"), "value")


_SUPPLIERS = """WITH w AS (SELECT l_suppkey AS x, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS y, o_orderpriority AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT least(x, y) AS u, greatest(x, y) AS v, list_sort(list(DISTINCT g)) AS g FROM w WHERE x <> y GROUP BY 1, 2), h AS (SELECT u AS node, v AS nbr, g FROM e UNION ALL SELECT v, u, g FROM e),
s AS (SELECT x.node, x.nbr AS "left", y.nbr AS "right", list_intersect(x.g, y.g) AS g FROM h x JOIN h y ON x.node = y.node AND x.nbr < y.nbr WHERE x.node IN (SELECT node FROM h GROUP BY node HAVING count(*) >= 3) AND len(list_intersect(x.g, y.g)) >= 2)"""


def _supplier_edges(spark, sf_dir):
    """Suppliers next to each other in an order; priorities are the genomes."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    steps = li.select(F.col("l_suppkey").alias("src"), nxt.alias("dst"), F.col("o_orderpriority").alias("genome")).where("dst IS NOT NULL")
    return written(genegraph.edges_of(steps), "edges")


@query("variants_two_genomes", _SUPPLIERS + ' SELECT node, "left", "right", len(g)::INT AS n_genomes FROM s')
def q_sv_two(spark, sf_dir):
    """Structural variants at the usual support of two genomes."""
    return genegraph.structural_variants(_supplier_edges(spark, sf_dir))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("structural_rtab", _SUPPLIERS + ' SELECT node, "left", "right", ' + ", ".join(f"list_contains(g, '{p}')::INT AS \"{p}\"" for p in _PRIORITIES) + " FROM s")
def q_sv_rtab(spark, sf_dir):
    edges = _supplier_edges(spark, sf_dir)
    return genegraph.structural_rtab(genegraph.structural_variants(edges), edges, list(_PRIORITIES))


@query("roary_wide", """WITH m AS (SELECT l_suppkey AS gene, l_returnflag AS genome, l_orderkey * 10 + l_linenumber AS orf, l_quantity::INT AS length, l_linestatus AS annotation FROM lineitem),
f AS (SELECT gene, length, count(*) AS k FROM m GROUP BY ALL), t AS (SELECT gene, min(length) AS mode_length FROM (SELECT *, max(k) OVER (PARTITION BY gene) AS top FROM f) WHERE k = top GROUP BY gene)
SELECT m.gene, string_agg(DISTINCT annotation, ';' ORDER BY annotation) AS annotation, count(DISTINCT genome) AS n_isolates, count(*) AS n_sequences, round(count(*) / count(DISTINCT genome), 2) AS mean_per_isolate,
  min(length) AS min_length, max(length) AS max_length, round(avg(length), 2) AS mean_length, any_value(mode_length) AS mode_length, """ + ", ".join(f"md5(string_agg(CASE WHEN genome = '{g}' THEN orf::VARCHAR END, ';' ORDER BY orf::VARCHAR)) AS {g}" for g in "ANR") + " FROM m JOIN t ON t.gene = m.gene GROUP BY m.gene")
def q_roary(spark, sf_dir):
    """The wide table of genes with a column an isolate; suppliers are genes and return flags isolates."""
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("genome"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("orf"), F.col("l_quantity").cast("int").alias("length"), F.col("l_linestatus").alias("annotation"))
    flags = matrix.genomes_of(m)
    out = matrix.roary_table(m, flags)
    return out.select(*[c for c in out.columns if c not in flags], *[F.md5(F.nullif(F.col(g), F.lit(""))).alias(g) for g in flags])


@query("codon_file", ORF_PAIRS_SQL.replace("('ATG', 'GTG', 'TTG')", "('ATG', 'CTG')").replace("'ATG', 'GTG', 'TTG', 'TAA', 'TGA', 'TAG'", "'ATG', 'CTG', 'TAA', 'TAG'").replace("'TAA', 'TGA', 'TAG'", "'TAA', 'TAG'"))
def q_codons(spark, sf_dir):
    """ORFs with the start and stop codons of a file."""
    path = _text(spark.createDataFrame([('{"codons":\n{"start": ["ATG", "CTG"], "stop": ["TAA", "TAG"]}}',)], "value string").coalesce(1), "codons")
    starts, stops = orf.read_codons(spark, path)
    d = balanced(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", S.dna(F.col("text")).alias("seq"))
    return orf.orf_pairs(d, "doc_id", "seq", starts=starts, stops=stops).withColumnRenamed("id", "doc_id").withColumns({c: F.col(c).cast("long") for c in ("frame", "start", "stop", "len")})


def _kept(df, kind):
    path = _place(df.sparkSession, f"saved-{kind}")
    saved.save(df, kind, path)
    return saved.load(df.sparkSession, kind, path)


@query("saved_orfs", f"WITH d AS (SELECT doc_id, {_DNA} FROM documents) SELECT doc_id AS genome_id, start * 3 + frame AS orf_id, md5(substr(seq, start + 1, len)) AS dna, len::DOUBLE AS score, len FROM ({ORF_PAIRS_SQL}) JOIN d USING (doc_id)")
def q_saved_orfs(spark, sf_dir):
    d = balanced(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", S.dna(F.col("text")).alias("seq"))
    o = orf.orf_pairs(d, "doc_id", "seq", with_dna=True)
    return _kept(o.select((F.col("start") * 3 + F.col("frame")).alias("orf_id"), F.col("id").alias("genome_id"), "dna", F.col("len").alias("score"), F.col("len").cast("long").alias("len")), "orfs").withColumn("dna", F.md5("dna"))


@query("saved_edges", "SELECT n_regionkey::BIGINT AS genome_id, n_nationkey::BIGINT AS src, (n_nationkey + 1)::BIGINT AS dst FROM nation")
def q_saved_edges(spark, sf_dir):
    return _kept(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 1).alias("dst"), F.col("n_regionkey").alias("genome_id")), "edges")


@query("saved_clusters", "SELECT s_nationkey::BIGINT AS cluster_id, s_suppkey AS orf_id, (s_suppkey % 7)::BIGINT AS genome_id, s_name FROM supplier")
def q_saved_clusters(spark, sf_dir):
    return _kept(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster_id"), F.col("s_suppkey").alias("orf_id"), (F.col("s_suppkey") % 7).alias("genome_id"), "s_name"), "clusters")


@query("saved_query_index", """WITH i AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS genome_id, l_orderkey AS orf_id FROM lineitem), q AS (SELECT DISTINCT p_brand AS query_id, p_partkey AS node FROM part WHERE p_size = 1)
SELECT genome_id, orf_id, string_agg(DISTINCT query_id, ';' ORDER BY query_id) AS queries FROM i JOIN q USING (node) GROUP BY genome_id, orf_id""")
def q_saved_index(spark, sf_dir):
    """Postings written, read and asked: the ORFs on the nodes that queries met."""
    li = table(spark, sf_dir, "lineitem")
    orfs = li.select(F.col("l_suppkey").alias("genome_id"), F.col("l_orderkey").alias("orf_id"), F.array(-F.col("l_partkey")).alias("nodes"))
    index = _kept(kmer.node_index(orfs).withColumnRenamed("node", "node_id"), "index").withColumnRenamed("node_id", "node")
    found = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("node"))
    return kmer.orfs_of_queries(found, index).withColumn("queries", F.array_join("queries", ";"))
