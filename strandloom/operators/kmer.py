"""K-mer tables, genome counts and sequence search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import canonical, kmers
from strandloom.session import written

#: Query k-mers that may be sent to all tasks, 16 bytes each.
BROADCAST_KMERS = 2_000_000


def kmer_table(seqs: DataFrame, id_col: str, seq_col: str, k: int, both_strands: bool = False) -> DataFrame:
    """(id, pos, kmer): every k-mer of every sequence; only ACGT if both strands are one."""
    out = seqs.select(F.col(id_col).alias("id"), F.posexplode(kmers(F.col(seq_col), k)).alias("pos", "kmer"))
    return out.where(~F.col("kmer").rlike("[^ACGT]")).withColumn("kmer", canonical(F.col("kmer"))) if both_strands else out


def distinct_kmers(seqs: DataFrame, id_col: str, seq_col: str, k: int, both_strands: bool = False) -> DataFrame:
    """(id, kmer): the distinct k-mers of every sequence, reduced inside its own row before any becomes a row."""
    each = F.array_distinct(kmers(F.col(seq_col), k))
    if both_strands:
        each = F.array_distinct(F.transform(F.filter(each, lambda x: ~x.rlike("[^ACGT]")), canonical))
    return seqs.select(F.col(id_col).alias("id"), F.explode(each).alias("kmer"))


def genome_counts(rows: DataFrame, genome: str, kmer: str) -> DataFrame:
    """(kmer, n_genomes): exact distinct counts. Distinct pairs combine before the shuffle, so a frequent k-mer is
    one row a task and genome."""
    return rows.select(genome, kmer).distinct().groupBy(kmer).agg(F.count("*").alias("n_genomes"))


#: ACGT as numbers from 0, and 4 for other bytes: of sequences, and of prose read as ``functions.sequence.dna`` does.
_BASES = np.full(256, 4, np.uint8)
_BASES[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2
_LETTERS = bytes((c & 31) - 1 & 3 if chr(c).isalpha() and c < 128 else 4 for c in range(256))
_OTHERS = bytes(c for c in range(256) if _LETTERS[c] == 4)
#: Words of 64 genomes of which a task keeps tables at a time, and characters that are sorted at a time.
WORDS, CHARACTERS = 8, 2_000_000


def _bases(text: str, prose: bool) -> np.ndarray:
    return np.frombuffer(text.encode().translate(_LETTERS, _OTHERS), np.uint8) if prose else _BASES[np.frombuffer(text.encode(), np.uint8)]


def _codes(bases: np.ndarray, k: int) -> np.ndarray:
    """The canonical k-mers as numbers of two bits a base, in order of their letters; only those of ACGT."""
    n = len(bases) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    one, two, other = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    known = not (bases > 3).any()
    for i in range(k):
        at = bases[i : i + n].astype(np.int64)
        one = one * 4 + at
        two += (3 - at) << (2 * i)
        if not known:
            other |= at > 3
    least = np.minimum(one, two)
    return least if known else least[~other]


def genomes_of_kmers(seqs: DataFrame, genome: str, seq: str, k: int, prose: bool = False) -> DataFrame:
    """(kmer, n_genomes): in how many genomes a canonical k-mer is, for k up to 10, as numbers of two bits a base.

    seqs (genome, seq), prose recoded as ``dna`` does. A task notes its genomes as bits in tables of all k-mers, so what is
    shuffled is a row a task, k-mer and 64 genomes, however long its sequences are. A null genome is none.
    """
    if not 0 < k <= 10:
        raise ValueError(f"k is {k}, not from 1 to 10")
    from strandloom.operators.dbg import dense_ids

    numbered = written(dense_ids(seqs.where(F.col(genome).isNotNull()).select(F.col(genome).alias("_g")).distinct(), "_g", "_i"), "genomes")
    listed = F.broadcast(numbered) if numbered.count() <= 100_000 else numbered
    rows = seqs.where(F.length(seq) >= k).join(listed, F.col(genome) == F.col("_g"), "left").select((F.col("_i") - 1).cast("long").alias("i"), F.col(seq).alias("seq"))

    def rows_of(tables):
        for word, table in tables.items():
            at = np.flatnonzero(table)
            for part in np.split(at, range(500_000, len(at), 500_000)):
                bits = np.zeros(len(part), np.int64) if word is None else table[part].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(np.full(len(part), word or 0)), pa.array(bits)], ["kmer", "word", "bits"])

    def scan(batches):
        tables: dict = {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                word = None if i is None else i // 64
                if word not in tables and len(tables) == WORDS:
                    yield from rows_of(tables)
                    tables = {}
                table = tables.setdefault(word, None)
                if table is None:
                    table = tables[word] = np.zeros(4**k, np.uint64)
                table[_codes(_bases(text.as_py(), prose), k)] |= np.uint64(1 << (0 if i is None else i % 64))
        yield from rows_of(tables)

    found = rows.mapInArrow(scan, "kmer long, word long, bits long").groupBy("kmer", "word").agg(F.bit_or("bits").alias("bits"))
    return found.groupBy("kmer").agg(F.sum(F.bit_count("bits")).alias("n_genomes"))


def kmer_counts(seqs: DataFrame, seq: str, k: int, prose: bool = False) -> DataFrame:
    """(kmer, n): how often a canonical k-mer of ACGT occurs, for k up to 31, as numbers of two bits a base.

    Counted within some million characters at a time before they are rows, and then only where they are shuffled to: a
    task holds those and its share of the k-mers.
    """
    if not 0 < k <= 31:
        raise ValueError(f"k is {k}, not from 1 to 31")

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                bases = _bases(text.as_py(), prose)
                for at in range(0, max(len(bases) - k + 1, 0), CHARACTERS):  # k-mers that begin there
                    held.append(_codes(bases[at : at + CHARACTERS + k - 1], k))
                    size += len(held[-1])
                    if size >= CHARACTERS:
                        yield counted(held)
                        held, size = [], 0
        if size:
            yield counted(held)

    def counted(held):
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["kmer", "n"])

    each = seqs.where(F.length(seq) >= k).select(F.col(seq).alias("seq")).mapInArrow(scan, "kmer long, n long")
    return each.repartition("kmer").groupBy("kmer").agg(F.sum("n").alias("n"))


def spelled(counts: DataFrame, k: int) -> DataFrame:
    """(kmer, n) with the k-mers as letters."""

    def spell(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy()
            letters = np.empty((len(codes), k), np.uint8)
            for i in range(k):
                letters[:, i] = np.frombuffer(b"ACGT", np.uint8)[(codes >> (2 * (k - 1 - i))) & 3]
            yield pa.RecordBatch.from_arrays([pa.array(letters.view(f"S{k}").ravel().astype(f"U{k}"), pa.string()), batch.column(1)], ["kmer", "n"])

    return counts.select("kmer", "n").mapInArrow(spell, "kmer string, n long")


def search(queries: DataFrame, targets: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, id, n_kmers, matched): targets with at least the share ``least`` of a query's distinct k-mers.

    queries (query_id, seq), targets (id, seq). Both sides join on hashes of distinct k-mers, so a repeated one counts
    once. The queries' are written and, if they are few, broadcast: then a target's k-mer becomes a row that is shuffled
    only if some query has it. Otherwise both sides are shuffled by k-mer.
    """
    hashed = lambda seq: F.explode(F.array_distinct(F.transform(kmers(seq, k), lambda x: F.xxhash64(x))))
    q = written(queries.select("query_id", hashed(F.col("seq")).alias("kmer")), "query-kmers")
    totals = q.groupBy("query_id").agg(F.count("*").alias("n_kmers"))
    t = targets.select("id", hashed(F.col("seq")).alias("_kmer"))
    hits = t.join(F.broadcast(q) if q.count() <= BROADCAST_KMERS else q, F.col("kmer") == F.col("_kmer")).groupBy("query_id", "id").agg(F.count("*").alias("matched"))
    return hits.join(totals, "query_id").where(F.col("matched") >= F.col("n_kmers") * least).select("query_id", "id", "n_kmers", "matched")


def node_index(orfs: DataFrame) -> DataFrame:
    """(node, genome_id, orf_id): postings of unsigned nodes; write it bucketed by node for repeated queries."""
    return orfs.select(F.explode(F.transform("nodes", F.abs)).alias("node"), "genome_id", "orf_id").distinct()


def orfs_of_queries(found: DataFrame, index: DataFrame) -> DataFrame:
    """found (query_id, node) -> (genome_id, orf_id, queries): ORFs on matched nodes with the sorted queries."""
    hit = found.select("query_id", F.abs("node").alias("n")).distinct()
    return index.join(hit, F.col("node") == F.col("n")).groupBy("genome_id", "orf_id").agg(F.sort_array(F.collect_set("query_id")).alias("queries"))
