"""Queries on presence/absence: genes are words of documents, genomes are sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.sequence import dna
from strandloom.operators import matrix
from strandloom.plans.orf_queries import DNA_SQL
from strandloom.plans.registry import query
from strandloom.session import balanced, table

PAIRS_SQL = "WITH pairs AS (SELECT DISTINCT source AS genome, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS gene FROM documents)"


def word_pairs(spark, sf_dir):
    d = balanced(table(spark, sf_dir, "documents").select("source", "text"))
    return matrix.presence(d.select("source", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), 0)).alias("word")), "source", "word")


@query("presence_absence", PAIRS_SQL + " SELECT gene, count(*) AS n_genomes, string_agg(genome, ';' ORDER BY genome) AS genomes FROM pairs GROUP BY gene")
def q_presence(spark, sf_dir):
    return word_pairs(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n_genomes"), F.array_join(F.sort_array(F.collect_set("genome")), ";").alias("genomes"))


_N = "(SELECT count(DISTINCT genome) FROM pairs)"
_SIZES = PAIRS_SQL + f", s AS (SELECT gene, count(*) AS n, count(*)::DOUBLE / {_N} AS share FROM pairs GROUP BY gene)"


@query("frequency_classes", _SIZES + """
SELECT 'core' AS class, count(*) AS n_genes FROM s WHERE share >= 0.99 UNION ALL SELECT 'soft_core', count(*) FROM s WHERE share >= 0.95 AND share < 0.99
UNION ALL SELECT 'shell', count(*) FROM s WHERE share >= 0.15 AND share < 0.95 UNION ALL SELECT 'cloud', count(*) FROM s WHERE share < 0.15 UNION ALL SELECT 'total', count(*) FROM s""")
def q_classes(spark, sf_dir):
    return matrix.frequency_classes(word_pairs(spark, sf_dir))


@query("frequency_histogram", _SIZES + f" SELECT least(n * 50 // {_N}, 49)::BIGINT AS bin, count(*) AS n_genes FROM s GROUP BY 1")
def q_histogram(spark, sf_dir):
    return matrix.frequency_histogram(word_pairs(spark, sf_dir))


@query("core_genes", _SIZES + f" SELECT gene, n AS n_genomes FROM s WHERE n >= 0.95 * {_N}")
def q_core(spark, sf_dir):
    return matrix.core_genes(word_pairs(spark, sf_dir))


@query("gene_distance", PAIRS_SQL + """, n AS (SELECT genome, count(*) AS n FROM pairs GROUP BY genome)
SELECT x.genome AS a, y.genome AS b, x.n + y.n - 2 * (SELECT count(*) FROM pairs p JOIN pairs q ON p.gene = q.gene AND p.genome = x.genome AND q.genome = y.genome) AS distance
FROM n x JOIN n y ON x.genome < y.genome""")
def q_gene_distance(spark, sf_dir):
    return matrix.gene_distances(word_pairs(spark, sf_dir))


@query("rarefaction", PAIRS_SQL + """, g AS (SELECT DISTINCT genome FROM pairs), p AS (SELECT genome, unnest(range(1, 51)) AS permutation FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY permutation ORDER BY md5('rarefaction:' || permutation || ':' || genome), genome) AS step FROM p),
m AS (SELECT permutation, gene, min(step) AS step FROM pairs JOIN s USING (genome) GROUP BY ALL), c AS (SELECT permutation, step, count(*) AS new_genes FROM m GROUP BY ALL)
SELECT s.permutation, s.step, coalesce(new_genes, 0) AS new_genes, (sum(coalesce(new_genes, 0)) OVER (PARTITION BY s.permutation ORDER BY s.step))::BIGINT AS total FROM s LEFT JOIN c USING (permutation, step)""")
def q_rarefaction(spark, sf_dir):
    return matrix.rarefaction(word_pairs(spark, sf_dir))


@query("snp_distance", f"""
WITH s AS (SELECT item_id AS id, string_split({DNA_SQL}, '') AS c FROM benchmark)
SELECT x.id AS a, y.id AS b, len(list_filter(range(1, least(len(x.c), len(y.c)) + 1), lambda i: x.c[i] <> y.c[i]))::BIGINT AS distance FROM s x JOIN s y ON x.id < y.id""")
def q_snp(spark, sf_dir):
    return matrix.snp_distances(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), dna(F.col("text")).alias("seq")))


_LEN_SQL = "WITH w AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS gene FROM documents), c AS (SELECT gene, source, doc_id, count(*) AS n FROM w GROUP BY ALL)"


@query("roary_lengths", _LEN_SQL + """, f AS (SELECT gene, n, count(*) AS k FROM c GROUP BY ALL), m AS (SELECT gene, min(n) AS mode_length FROM (SELECT *, max(k) OVER (PARTITION BY gene) AS top FROM f) WHERE k = top GROUP BY gene),
s AS (SELECT gene, count(DISTINCT source) AS n_isolates, count(*) AS n_sequences, min(n) AS min_length, max(n) AS max_length, sum(n)::BIGINT AS total FROM c GROUP BY gene)
SELECT * FROM s JOIN m USING (gene)""")
def q_roary_lengths(spark, sf_dir):
    """Summary columns of the wide table; a length is a word's count in a document."""
    d = balanced(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    c = d.select("source", "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), 0)).alias("gene")).groupBy("gene", "source", "doc_id").agg(F.count("*").alias("n"))
    return c.groupBy("gene").agg(F.count_distinct("source").alias("n_isolates"), F.count("*").alias("n_sequences"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.sum("n").alias("total"), F.mode("n", True).alias("mode_length"))



@query("gene_rtab", PAIRS_SQL + " SELECT gene, " + ", ".join(f"max((genome = 'src{i}')::INT)::INT AS src{i}" for i in range(20)) + " FROM pairs GROUP BY gene")
def q_rtab(spark, sf_dir):
    return matrix.rtab(word_pairs(spark, sf_dir))
