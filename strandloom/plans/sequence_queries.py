"""Queries on sequence functions, k-mers and paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import kmer
from strandloom.plans.orf_queries import DNA_SQL
from strandloom.plans.registry import query
from strandloom.session import balanced, table

AA_SQL = f"""array_to_string(list_transform(range(0, greatest(length(s) - 2, 0), 3), lambda i: substr('{S.AMINO_ACIDS}',
  (instr('{S.BASES}', substr(s, i + 1, 1)) - 1) * 16 + (instr('{S.BASES}', substr(s, i + 2, 1)) - 1) * 4 + instr('{S.BASES}', substr(s, i + 3, 1)), 1)), '')"""


@query("revcomp_translate", f"""
WITH d AS (SELECT item_id, {DNA_SQL} AS s FROM benchmark), t AS (SELECT item_id, s, {AA_SQL} AS p FROM d)
SELECT item_id, reverse(translate(s, 'ACGT', 'TGCA')) AS revcomp, p AS protein_full, regexp_extract(p, '^[^*]*\\*?', 0) AS protein FROM t""")
def q_translate(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", S.dna(F.col("text")).alias("s"))
    return d.select("item_id", S.reverse_complement(F.col("s")).alias("revcomp"), S.translate_full(F.col("s")).alias("protein_full"), S.translate_to_stop(F.col("s")).alias("protein"))


_STOPS_SQL = f"""
WITH s AS (SELECT doc_id, {DNA_SQL} AS seq FROM documents), b AS (SELECT doc_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rev FROM s),
c AS (SELECT doc_id, i, substr(seq, i + 1, 3) AS f, substr(rev, i + 1, 3) AS r, length(seq) AS n FROM (SELECT *, unnest(range(0, greatest(length(seq) - 2, 0))) AS i FROM b))"""


@query("stop_codon_freq", _STOPS_SQL + " SELECT sum((f IN ('TAA','TGA','TAG'))::INT + (r IN ('TAA','TGA','TAG'))::INT)::BIGINT AS n_stops, (2 * count(*))::BIGINT AS n_sites FROM c")
def q_stop_freq(spark, sf_dir):
    d = balanced(table(spark, sf_dir, "documents").select("text")).select(S.dna(F.col("text")).alias("s"))
    n = F.size(S.codon_positions(F.col("s"))) + F.size(S.codon_positions(S.reverse_complement(F.col("s"))))
    return d.agg(F.sum(n).alias("n_stops"), F.sum(F.greatest(F.length("s") - 2, F.lit(0)) * 2).cast("long").alias("n_sites"))


def _mask_sql(col):
    return f"coalesce(bit_or(CASE WHEN {col} IN ('TAA','TGA','TAG') THEN 1 << (i % 3)::INT ELSE 0 END), 0)::INT"


@query("frame_mask", _STOPS_SQL + f""", m AS (SELECT d.doc_id, {_mask_sql('f')} AS fwd, {_mask_sql('r')} AS rev FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, fwd, rev, fwd | (((fwd >> 2) & 1) << 3) | ((fwd & 1) << 4) | (((fwd >> 1) & 1) << 5) | (((fwd >> 1) & 1) << 6) | (((fwd >> 2) & 1) << 7) | ((fwd & 1) << 8) AS fwd_partial FROM m""")
def q_frame_mask(spark, sf_dir):
    d = balanced(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", S.dna(F.col("text")).alias("s"))
    m = d.select("doc_id", S.frame_mask(S.codon_positions(F.col("s"))).alias("fwd"), S.frame_mask(S.codon_positions(S.reverse_complement(F.col("s")))).alias("rev"))
    return m.withColumn("fwd_partial", S.partial_masks(F.col("fwd")))


@query("kmer_genome_count", f"""
WITH s AS (SELECT source, {DNA_SQL} AS seq FROM documents), k AS (SELECT source, unnest(list_transform(range(1, greatest(length(seq) - 8, 1)), lambda i: substr(seq, i, 10))) AS kmer FROM s),
c AS (SELECT source, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM k)
SELECT n_genomes, count(*) AS n_kmers FROM (SELECT kmer, count(DISTINCT source) AS n_genomes FROM c GROUP BY kmer) GROUP BY n_genomes""")
def q_kmer_genomes(spark, sf_dir):
    counts = kmer.genomes_of_kmers(balanced(table(spark, sf_dir, "documents").select("source", "text")), "source", "text", 10, prose=True)
    return counts.groupBy("n_genomes").agg(F.count("*").alias("n_kmers"))


@query("start_site_count", f"""
WITH s AS (SELECT source, {DNA_SQL} AS seq FROM documents), c AS (SELECT source, seq, unnest(range(1, greatest(length(seq) - 10, 1))) AS i FROM s),
t AS (SELECT source, substr(seq, i, 12) AS s FROM c WHERE substr(seq, i, 3) IN ('ATG', 'GTG', 'TTG'))
SELECT site, count(DISTINCT source) AS n_genomes FROM (SELECT source, {AA_SQL} AS site FROM t) GROUP BY site""")
def q_start_sites(spark, sf_dir):
    """Genomes per amino acid 4-mer at a start codon."""
    d = balanced(table(spark, sf_dir, "documents").select("source", "text")).select("source", S.dna(F.col("text")).alias("s"))
    at = d.select("source", "s", F.explode(S.codon_positions(F.col("s"), S.START_CODONS)).alias("i")).where(F.col("i") + 12 <= F.length("s"))
    sites = at.select("source", F.substr("s", F.col("i") + 1, F.lit(12)).alias("x")).distinct().select("source", S.translate_full(F.col("x")).alias("site"))
    return kmer.genome_counts(sites, "source", "site")


@query("kmer_search", """
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(list_transform(range(1, greatest(length(text) - 22, 1)), lambda i: substr(text, i, 24))) AS kmer FROM benchmark),
n AS (SELECT query_id, count(*) AS n_kmers FROM q GROUP BY query_id),
t AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(text) - 22, 1)), lambda i: substr(text, i, 24))) AS kmer FROM documents),
h AS (SELECT query_id, doc_id, count(*) AS matched FROM q JOIN t USING (kmer) GROUP BY ALL)
SELECT query_id, doc_id, n_kmers, matched FROM h JOIN n USING (query_id) WHERE matched >= n_kmers * 0.5""")
def q_kmer_search(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("seq"))
    t = balanced(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq")))
    return kmer.search(q, t, 24, 0.5).withColumnRenamed("id", "doc_id")


@query("node_path_runs", """
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS contig_end
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def q_path_runs(spark, sf_dir):
    from strandloom.operators.paths import collapse_runs

    out = collapse_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.select("user_id", "event_id", "event_type", F.col("pos").cast("long").alias("pos"), "contig_end")


@query("next_event_asof", """
SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase FROM events""")
def q_next_event(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select("event_id", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w).alias("next_purchase"))


@query("path_contains", """
WITH p AS (SELECT user_id, ',' || string_agg(event_type, ',' ORDER BY ts, event_id) || ',' AS path FROM events GROUP BY user_id)
SELECT user_id, contains(path, ',click,view,') AS forward, contains(path, ',view,click,') AS backward FROM p""")
def q_path_contains(spark, sf_dir):
    from strandloom.operators.paths import path_text

    p = path_text(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return p.select("user_id", F.col("path").contains(",click,view,").alias("forward"), F.col("path").contains(",view,click,").alias("backward"))
