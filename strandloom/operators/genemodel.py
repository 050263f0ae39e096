"""A gene scorer of a genome's own: what its long ORFs read like, by codon position, against the genome as a whole.

Bases are predicted from up to five before them. A context's shares are mixed with those of the context that is one base
shorter, by how often it was seen, so rare contexts lean on shorter ones. Counts are made in each batch and summed by
Spark; a genome's model has 16,384 counts at most, and ORFs are scored in parts of a genome beside its model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import written

ORDER = 5
WORDS = 4 ** (ORDER + 1)
#: How many bases seen the shorter context counts for.
WEIGHT = 16.0
#: Rows that are scored in one group.
PART_ROWS = 20_000
#: Bases at each side of a start, as of ``calling.tis_window``.
SIDE = 16

_CODE = np.full(256, 4, np.int64)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]


def codes(seq: str) -> np.ndarray:
    """Bases as 0 to 3, others as 4."""
    return _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def word_ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ORDER + 1`` bases by number, and where their last bases are; words with other letters are left out."""
    n = len(x) - ORDER
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, good = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(ORDER + 1):
        word = 4 * word + x[j : j + n]
        good &= x[j : j + n] < 4
    at = np.flatnonzero(good)
    return word[at], at + ORDER


def coding_slots(seq: str) -> np.ndarray:
    """Codon position and word of each base of an ORF that has a whole context in it."""
    word, at = word_ends(codes(seq))
    return at % 3 * WORDS + word


def background_slots(seq: str) -> np.ndarray:
    """The words of both strands of a contig."""
    x = codes(seq)
    back = np.where(x < 4, 3 - x, 4)[::-1]
    return 3 * WORDS + np.concatenate((word_ends(x)[0], word_ends(back)[0]))


def window_slots(window: str) -> np.ndarray:
    """Place and base of each letter around a start."""
    x = codes(window)
    at = np.flatnonzero(x < 4)
    return 4 * at + x[at]


def counted(rows: DataFrame, slots: Callable[[str], np.ndarray], n_slots: int) -> DataFrame:
    """(genome_id, slot, n): how often each slot occurs, from rows (genome_id, seq); nulls count nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for genome, of in b.groupby("genome_id", dropna=False)["seq"]:
                n = np.zeros(n_slots, np.int64)
                for seq in of.dropna():
                    np.add.at(n, slots(seq), 1)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"genome_id": [genome] * len(at), "slot": at.astype(np.int32), "n": n[at]})

    kind = rows.schema["genome_id"].dataType.simpleString()
    each = rows.select("genome_id", "seq").where("genome_id IS NOT NULL AND seq IS NOT NULL").mapInPandas(run, f"genome_id {kind}, slot int, n long")
    return each.groupBy("genome_id", "slot").agg(F.sum("n").alias("n"))


def shares(n: np.ndarray) -> np.ndarray:
    """The share of each base after each context of five, from counts of words."""
    p = np.full((1, 4), 0.25)
    for c in range(ORDER + 1):
        seen = n.reshape(-1, 4**c, 4).sum(0)
        # the contexts that differ in their first base only share the one that is a base shorter
        p = (seen + WEIGHT * (np.tile(p, (4, 1)) if c else p)) / (seen.sum(1, keepdims=True) + WEIGHT)
    return p.reshape(-1)


def coding_odds(n: np.ndarray) -> np.ndarray:
    """Log odds of each word at each codon position, from all slots' counts."""
    n = n.reshape(4, WORDS).astype(float)
    return np.concatenate([np.log(shares(n[f])) for f in range(3)]) - np.tile(np.log(shares(n[3])), 3)


def start_odds(n: np.ndarray) -> np.ndarray:
    """Log odds of each base at each place around a start against its share in all places."""
    n = n.reshape(-1, 4).astype(float)
    base = (n.sum(0) + 1) / (n.sum() + 4)
    return np.log((n + 4 * base) / (n.sum(1, keepdims=True) + 4) / base).reshape(-1)


def models(counts: DataFrame, odds: Callable[[np.ndarray], np.ndarray], n_slots: int) -> DataFrame:
    """(genome_id, odds): a row a genome, from (genome_id, slot, n)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(n_slots, np.int64)
        n[pdf["slot"].to_numpy()] = pdf["n"].to_numpy()
        return pd.DataFrame({"genome_id": pdf["genome_id"].iloc[:1], "odds": [odds(n)]})

    kind = counts.schema["genome_id"].dataType.simpleString()
    return counts.groupBy("genome_id").applyInPandas(fit, f"genome_id {kind}, odds array<double>")


def coding_models(training: DataFrame, background: DataFrame) -> DataFrame:
    """(genome_id, odds): from training (genome_id, seq), coding sequences in frame, and what ``background`` counts.

    A genome without training sequences gets a model too, which tells little: all that is coding looks even there.
    """
    of = counted(training, coding_slots, 4 * WORDS).unionByName(background)
    return written(models(of, coding_odds, 4 * WORDS), "coding-models")


def background(contigs: DataFrame) -> DataFrame:
    """(genome_id, slot, n): the words of both strands of contigs (genome_id, seq)."""
    return written(counted(contigs, background_slots, 4 * WORDS), "background")


def start_models(training: DataFrame) -> DataFrame:
    """(genome_id, odds): from windows (genome_id, seq) around starts, as of ``calling.tis_window``."""
    n = 8 * SIDE
    return written(models(counted(training, window_slots, n), start_odds, n), "start-models")


def log_odds(rows: DataFrame, fitted: DataFrame, slots: Callable[[str], np.ndarray], name: str) -> DataFrame:
    """(genome_id, seq, name): of each distinct sequence of a genome the sum of its model's log odds, 0 without a model
    or without a slot. rows (genome_id, seq)."""
    each = rows.select("genome_id", "seq").where("genome_id IS NOT NULL AND seq IS NOT NULL").distinct()
    sizes = each.groupBy("genome_id").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
    spread = each.join(sizes, "genome_id").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("_parts")).cast("int")).drop("_parts")
    copied = fitted.join(sizes, "genome_id").select("genome_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "odds")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        odds = np.asarray(right["odds"].iloc[0]) if len(right) else None
        out = [0.0 if odds is None else float(odds[slots(s)].sum()) for s in left["seq"]]
        return pd.DataFrame({"genome_id": left["genome_id"], "seq": left["seq"], name: out})

    kind = rows.schema["genome_id"].dataType.simpleString()
    return spread.groupBy("genome_id", "part").cogroup(copied.groupBy("genome_id", "part")).applyInPandas(score, f"genome_id {kind}, seq string, `{name}` double")


def probability(odds: Column) -> Column:
    """Log odds as a probability, never quite 0 or 1."""
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))


def halves(orfs: DataFrame, training: DataFrame, words: DataFrame) -> DataFrame:
    """(genome_id, seq, odds): each sequence by a model of the training sequences in the other half, by hash, so none is
    thought coding because it taught the model."""
    half = F.pmod(F.xxhash64("seq"), F.lit(2))
    one, two = (log_odds(orfs.where(half == h), coding_models(training.where(half == 1 - h), words), coding_slots, "odds") for h in (0, 1))
    return one.unionByName(two)


def self_trained(orfs: DataFrame, contigs: DataFrame, least: int = 300, rounds: int = 2) -> DataFrame:
    """(genome_id, seq, odds): log odds of each distinct ORF of being coding, by models that its genome's own ORFs
    teach. orfs (genome_id, seq) in frame, contigs (genome_id, seq).

    First all ORFs of at least ``least`` bases are taken as coding; in each further round those of them that the round
    before thinks coding, so long ORFs in the shadow of genes, in another frame, drop out. Most ORFs of that length
    should be genes; where chance makes long ones too (few stop codons), ``least`` is to be raised.
    """
    words = background(contigs)
    training = written(orfs.select("genome_id", "seq").where(F.length("seq") >= least).distinct(), "training")
    long = training
    for _ in range(rounds - 1):
        training = written(halves(long, training, words).where("odds > 0").select("genome_id", "seq"), "training")
    return halves(orfs, training, words)
