"""Models of coding sequences and of starts, against dictionaries of counts and on planted genes."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import genemodel as gm


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_share(n, context, base):
    """By definition, from the longest context down."""
    if context is None:
        return 0.25
    seen = [sum(m for w, m in n.items() if w[gm.ORDER - len(context) :] == context + b) for b in "ACGT"]
    return (seen["ACGT".index(base)] + gm.WEIGHT * plain_share(n, context[1:] if context else None, base)) / (sum(seen) + gm.WEIGHT)


def words(s):
    return [(s[i - gm.ORDER : i + 1], i) for i in range(gm.ORDER, len(s)) if set(s[i - gm.ORDER : i + 1]) <= set("ACGT")]


def test_odds_by_definition(spark):
    r = random.Random(5)
    make = lambda n, letters="ACGT": "".join(r.choices(letters, k=n))
    genes = [(g, make(60 + 3 * i, "ACGGT")) for g in ("a", "b") for i in range(4)] + [("a", "ACG"), ("a", None), (None, "ACGTACGT"), ("a", "ACGTNACGTACGA")]
    contigs = [(g, make(150)) for g in ("a", "b", "c")] + [("a", "ACGNNACGTTGCA"), ("c", "")]
    df = lambda rows: spark.createDataFrame(rows, "genome_id string, seq string").repartition(3)
    fitted = gm.coding_models(df(genes), gm.background(df(contigs)))
    assert sorted(x.genome_id for x in fitted.collect()) == ["a", "b", "c"]
    tests = [("a", genes[0][1]), ("a", "ACGTNACGTACGA"), ("b", genes[0][1]), ("b", genes[0][1]), ("c", make(40)), ("d", make(40)), ("b", ""), ("b", None)]
    got = {(x.genome_id, x.seq): x.odds for x in gm.log_odds(df(tests), fitted, gm.coding_slots, "odds").collect()}
    assert set(got) == {t for t in tests if t[1] is not None}
    for g, s in got:
        coding = [Counter(w for h, t in genes if h == g and t for w, i in words(t) if i % 3 == f) for f in range(3)]
        back = Counter(w for h, t in contigs if h == g for x in (t, rc(t)) for w, _ in words(x))
        want = sum(math.log(plain_share(coding[i % 3], w[:-1], w[-1]) / plain_share(back, w[:-1], w[-1])) for w, i in words(s)) if g != "d" else 0
        assert got[g, s] == pytest.approx(want, abs=1e-9)


def test_shares_make_one():
    n = np.random.default_rng(2).integers(0, 9, gm.WORDS)
    assert gm.shares(n.astype(float)).reshape(-1, 4).sum(1) == pytest.approx(np.ones(gm.WORDS // 4))


def coding(r, n):
    """A gene of a favoured set of codons, without stops inside."""
    return "ATG" + "".join(r.choices(("GCT", "GAA", "CTG", "AAA", "GGT", "GTT", "ATC", "CGT"), (8, 7, 7, 6, 5, 4, 3, 2), k=n)) + "TAA"


@pytest.fixture(scope="module")
def genome():
    """Two genomes of different composition: genes, and open stretches of chance, as (genome, sequence, is a gene)."""
    r, orfs, contigs = random.Random(8), [], []
    for g, letters in ((0, "ACGT"), (1, "AACGT")):
        stops = ("TAA", "TGA", "TAG")
        genes = [coding(r, r.randrange(40, 300)) for _ in range(60)]
        chance = []
        while len(chance) < 60:
            s = [c for c in ("".join(r.choices(letters, k=3)) for _ in range(r.randrange(40, 200))) if c not in stops]
            chance.append("ATG" + "".join(s) + "TAA")
        orfs += [(g, s, True) for s in genes] + [(g, s, False) for s in chance]
        contigs += [(g, x + "".join(r.choices(letters, k=300)) + (y if i % 2 else rc(y))) for i, (x, y) in enumerate(zip(genes, chance))]
    return orfs, contigs


def test_planted_genes_score_above_chance(spark, genome):
    orfs, contigs = genome
    df, of = spark.createDataFrame(orfs, "genome_id int, seq string, gene boolean"), spark.createDataFrame(contigs, "genome_id int, seq string")
    got = {(x.genome_id, x.seq): x.odds for x in gm.self_trained(df, of, 300).collect()}
    assert set(got) == {(g, s) for g, s, _ in orfs}
    for g in (0, 1):
        yes, no = ([got[h, s] for h, s, is_gene in orfs if h == g and is_gene == k] for k in (True, False))
        assert min(yes) > 0 and sum(x > 0 for x in no) <= 3 and min(yes) > sorted(no)[-4]
    p = spark.createDataFrame([(x,) for x in (-1e9, 0.0, 2.0, 1e9)], "x double").select(gm.probability(F.col("x"))).collect()
    assert 0 < p[0][0] < 1e-12 and p[1][0] == 0.5 and p[2][0] == pytest.approx(1 / (1 + math.exp(-2))) and 1 - 1e-12 < p[3][0] < 1


def test_workflow_leaves_chance_out(spark, genome):
    from strandloom import workflow

    orfs, contigs = genome
    of = spark.createDataFrame([(g, i, s) for i, (g, s) in enumerate(contigs)], "genome_id long, contig_id long, seq string")
    found = lambda s: [(r.genome_id, r.dna) for r in workflow.called(of, s).select("genome_id", "dna").collect()]
    own, constant = found(workflow.Settings(self_trained=True)), found(workflow.Settings())
    genes = {(g, s) for g, s, is_gene in orfs if is_gene}
    assert genes <= set(own) and len(genes) == 120
    chance = [(g, s) for g, s, is_gene in orfs if not is_gene]
    seen = lambda rows: sum(any(h == g and s.endswith(x) for h, x in rows) for g, s in chance)
    assert seen(own) <= 2 < 60 < seen(constant)
    assert len(own) < len(constant) / 2


def test_parts_of_a_genome_agree(spark, genome, monkeypatch):
    orfs, contigs = genome
    df, of = spark.createDataFrame(orfs, "genome_id int, seq string, gene boolean"), spark.createDataFrame(contigs, "genome_id int, seq string")
    fitted = gm.coding_models(df.where("gene"), gm.background(of))
    one = {tuple(x) for x in gm.log_odds(df, fitted, gm.coding_slots, "odds").collect()}
    monkeypatch.setattr(gm, "PART_ROWS", 7)
    assert {tuple(x) for x in gm.log_odds(df, fitted, gm.coding_slots, "odds").collect()} == one


def test_starts(spark):
    r = random.Random(1)
    # a ribosome's site, at one place before the start
    real = ["".join(r.choices("ACGT", k=20)) + "GGAGG" + "".join(r.choices("ACGT", k=7)) for _ in range(80)]
    other = ["".join(r.choices("ACGT", k=32)) for _ in range(80)]
    df = lambda rows: spark.createDataFrame([(0, s) for s in rows], "genome_id int, seq string")
    fitted = gm.start_models(df(real))
    got = {x.seq: x.tis for x in gm.log_odds(df(real + other + ["NNNN", "ACG"]), fitted, gm.window_slots, "tis").collect()}
    assert sum(got[s] > 0 for s in real) == 80 and sum(got[s] > 0 for s in other) <= 4 and got["NNNN"] == 0
    n = np.zeros((32, 4))
    for s in real:
        n[np.arange(32), ["ACGT".index(c) for c in s]] += 1
    base = (n.sum(0) + 1) / (n.sum() + 4)
    want = sum(math.log((n[i, c] + 4 * base[c]) / (80 + 4) / base[c]) for i, c in enumerate("ACGT".index(c) for c in other[0]))
    assert got[other[0]] == pytest.approx(want, abs=1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], "genome_id int, seq string")
    assert gm.self_trained(none, none).count() == 0 and gm.start_models(none).count() == 0
