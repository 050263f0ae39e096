"""Queries on gene models that genomes teach; documents are contigs, and those of a source are a genome."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import genemodel
from strandloom.plans.graph_queries import LONGEST_SQL, longest_orfs
from strandloom.plans.orf_queries import DNA_SQL
from strandloom.plans.registry import query
from strandloom.session import balanced, table, written

#: ORFs of so many bases teach.
LEAST = 150

_W, _O = genemodel.WEIGHT, genemodel.ORDER
_SUMS = ", ".join(f"sum(n) OVER (PARTITION BY genome, f, right(word, {c + 1})) AS s{c}, sum(n) OVER (PARTITION BY genome, f, substr(word, {_O + 1 - c}, {c})) AS d{c}" for c in range(_O + 1))
_SHARE = "0.25"
for _c in range(_O + 1):
    _SHARE = f"(s{_c} + {_W} * {_SHARE}) / (d{_c} + {_W})"


@query("orf_coding_odds", f"""WITH {LONGEST_SQL}, q AS (SELECT doc_id, coalesce(source, '') AS genome, {DNA_SQL} AS seq FROM documents),
r AS (SELECT DISTINCT genome, substr(seq, (start + 1)::INT, (stop_end - start)::INT) AS dna FROM n JOIN q USING (doc_id)),
x AS (SELECT genome, dna, i % 3 AS f, substr(dna, (i - {_O - 1})::INT, {_O + 1}) AS word FROM (SELECT *, unnest(range({_O}, length(dna))) AS i FROM r)),
z AS (SELECT genome, unnest([seq, reverse(translate(seq, 'ACGT', 'TGCA'))]) AS seq FROM q),
y AS (SELECT genome, 3 AS f, substr(seq, i::INT, {_O + 1}) AS word FROM (SELECT *, unnest(range(1, greatest(length(seq) - {_O - 1}, 1))) AS i FROM z)),
u AS (SELECT genome, f, word, count(*) AS n FROM x WHERE length(dna) >= {LEAST} GROUP BY ALL UNION ALL SELECT genome, f, word, count(*) FROM y GROUP BY ALL
  UNION ALL SELECT DISTINCT genome, f, word, 0 FROM x UNION ALL SELECT DISTINCT genome, 3, word, 0 FROM x),
g AS (SELECT genome, f, word, sum(n) AS n FROM u GROUP BY ALL), w AS (SELECT genome, f, word, {_SUMS} FROM g),
p AS (SELECT genome, f, word, ln({_SHARE}) AS lp FROM w)
SELECT genome, md5(dna) AS dna_md5, round(sum(a.lp - b.lp), 4) AS odds FROM x JOIN p a USING (genome, f, word) JOIN p b ON b.genome = x.genome AND b.f = 3 AND b.word = x.word GROUP BY genome, dna""")
def q_orf_coding_odds(spark, sf_dir):
    """How much each ORF reads like the long ones of its source, in log odds against all the source's texts."""
    docs = balanced(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    contigs = written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("genome_id"), S.dna(F.col("text")).alias("seq")), "contigs")
    found = longest_orfs(spark, sf_dir).select(F.col("key").alias("doc_id"), "start", "stop_end").join(contigs, "doc_id")
    orfs = written(found.select("genome_id", F.substr("seq", F.col("start") + 1, F.col("stop_end") - F.col("start")).alias("seq")).distinct(), "orfs")
    fitted = genemodel.coding_models(orfs.where(F.length("seq") >= LEAST), genemodel.background(contigs.select("genome_id", "seq")))
    out = genemodel.log_odds(orfs, fitted, genemodel.coding_slots, "odds")
    return out.select(F.col("genome_id").alias("genome"), F.md5("seq").alias("dna_md5"), F.round("odds", 4).alias("odds"))
