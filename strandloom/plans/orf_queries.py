"""Queries on open reading frames; ``documents`` recoded as DNA stand for contigs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators.orf import orf_pairs
from strandloom.plans.registry import query
from strandloom.session import balanced, table

#: DuckDB text of functions.sequence.dna.
DNA_SQL = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"

ORF_PAIRS_SQL = f"""
WITH s AS (SELECT doc_id, {DNA_SQL} AS seq FROM documents),
c AS (SELECT doc_id, pos, substr(seq, pos + 1, 3) AS codon FROM (SELECT doc_id, seq, unnest(range(0, greatest(length(seq) - 2, 0))) AS pos FROM s)),
k AS (SELECT doc_id, pos % 3 AS frame, pos, codon IN ('ATG', 'GTG', 'TTG') AS is_start, CASE WHEN codon IN ('TAA', 'TGA', 'TAG') THEN pos END AS stop_at FROM c
      WHERE codon IN ('ATG', 'GTG', 'TTG', 'TAA', 'TGA', 'TAG')),
p AS (SELECT doc_id, frame, pos, is_start, min(stop_at) OVER (PARTITION BY doc_id, frame ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM k)
SELECT doc_id, frame, pos AS start, stop, stop + 3 - pos AS len FROM p WHERE is_start AND stop IS NOT NULL AND stop + 3 - pos >= 90"""


BOTH_SQL = f"""WITH d AS (SELECT item_id, {DNA_SQL} AS q FROM benchmark), s AS (SELECT item_id, 1 AS strand, q, length(q) AS n FROM d UNION ALL SELECT item_id, -1, reverse(translate(q, 'ACGT', 'TGCA')), length(q) FROM d),
c AS (SELECT item_id, strand, n, pos, substr(q, pos + 1, 3) AS codon, pos % 3 AS frame FROM (SELECT *, unnest(range(0, greatest(n - 2, 0))) AS pos FROM s)),
k AS (SELECT *, codon IN ('ATG', 'GTG', 'TTG') AS is_start, min(CASE WHEN codon IN ('TAA', 'TGA', 'TAG') THEN pos END) OVER (PARTITION BY item_id, strand, frame ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop,
  max(pos) OVER (PARTITION BY item_id, strand, frame) AS final FROM c),
o AS (SELECT item_id, strand, n, frame, pos, stop, coalesce(stop, final) + 3 - pos AS len, NOT is_start AS partial5, stop IS NULL AS partial3 FROM k WHERE is_start OR pos < 3)
SELECT item_id, strand, frame, CASE WHEN strand > 0 THEN pos ELSE n - pos - len END AS start, CASE WHEN strand > 0 THEN pos + len ELSE n - pos END AS "end", stop, len, partial5, partial3 FROM o WHERE len >= 30"""


@query("orf_pairs", ORF_PAIRS_SQL)
def q_orf_pairs(spark, sf_dir):
    return orf_pairs(balanced(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", prose=True).withColumnRenamed("id", "doc_id").withColumns({c: F.col(c).cast("long") for c in ("frame", "start", "stop", "len")})
