"""From made-up genomes with planted genes to the presence table and the files."""

import random

import pytest

from pyspark.sql import functions as F

from strandloom import workflow
from strandloom.functions import sequence as S

AA = "ACDEFGHIKLMNPQRSTVWY"
CODON = {a: c for c, a in S.CODON_TABLE.items()}
SPACER = "TAACTAGTTAGCTAACTAGTTAGC"  # stops in all six frames


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def open_codons(s):
    """The longest stretch without a stop in the five other frames."""
    frames = [t[f : len(t) - (len(t) - f) % 3] for t in (s, revcomp(s)) for f in (0, 1, 2)][1:]
    return max(len(run) for t in frames for run in "".join("." if t[i : i + 3] not in S.STOP_CODONS else " " for i in range(0, len(t), 3)).split(" "))


def gene(rng, n=80):
    spelled = {}
    for codon, a in S.CODON_TABLE.items():
        spelled.setdefault(a, []).append(codon)
    while True:
        s = "ATG" + "".join(rng.choice([c for c in spelled[rng.choice(AA)] if c not in S.START_CODONS] or ["GCA"]) for _ in range(n)) + "TAA"
        if open_codons(s) < 29:
            return s


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(17)
    genes, rare = [gene(rng) for _ in range(7)], gene(rng)
    genomes, has = [], []
    for g in range(4):
        own = [k for k in range(7) if not (g == 2 and k == 3)]  # one genome lacks a gene
        text = SPACER
        for k in own:
            s = genes[k]
            if g == 1 and k == 5:  # a single substitution: the same cluster
                at = 3 * 40
                s = s[:at] + CODON["W" if S.CODON_TABLE[s[at : at + 3]] != "W" else "A"] + s[at + 3 :]
            text += (revcomp(s) if k % 2 else s) + SPACER
        if g == 3:  # what one genome alone has at a contig's end
            text += rare + SPACER
        genomes.append(text)
        has.append(own)
    return genes, genomes, has, rare


def test_planted_genes_are_found(spark, planted, tmp_path):
    genes, genomes, has, rare = planted
    listing = []
    for g, text in enumerate(genomes):
        path = tmp_path / f"iso{g}.fa"
        path.write_text(f">contig of {g}\n" + "\n".join(text[i : i + 60] for i in range(0, len(text), 60)).lower() + "\n")
        listing.append(str(path))
    (tmp_path / "list.txt").write_text("\n".join(listing))
    contigs = workflow.read_genomes(spark, str(tmp_path / "list.txt"))
    assert {(r.genome_id, r.isolate, r.seq) for r in contigs.collect()} == {(g, f"iso{g}", t) for g, t in enumerate(genomes)}
    out = workflow.run(contigs, workflow.Settings(len_cutoff=0.95, identity=0.95))
    found = {(r.genome_id, r.dna) for r in out["orfs"].collect()}
    for g, own in enumerate(has):
        for k in own:
            assert (g, genes[k]) in found or (g == 1 and k == 5)
    # every planted gene is one cluster of the genomes that have it
    node_of = {(r.genome, r.orf): r.node for r in out["members"].collect()}
    assert (3, rare) in found and not {(r.genome_id, r.orf_id) for r in out["orfs"].collect() if r.dna == rare} & set(node_of)  # trimmed
    dna_of = {(r.genome_id, r.orf_id): r.dna for r in out["orfs"].collect()}
    for k, s in enumerate(genes):
        nodes = {node_of[x] for x, d in dna_of.items() if d == s}
        assert len(nodes) == 1
        assert sorted(g for (g, o), n in node_of.items() if n in nodes) == [g for g in range(4) if k in has[g]]
    assert out["presence"].groupBy("gene").count().where("count = 4").count() >= 6
    ends = {frozenset((r.u, r.v)): r.n_genomes for r in out["edges"].collect()}
    first, second = ({node_of[x] for x, d in dna_of.items() if d == genes[k]}.pop() for k in (0, 1))
    assert ends[frozenset((first, second))] == 4
    workflow.write(out, contigs, str(tmp_path / "out"))
    rtab = spark.read.csv(str(tmp_path / "out" / "gene_presence_absence.Rtab"), sep="\t", header=True)
    assert rtab.columns == ["gene", "iso0", "iso1", "iso2", "iso3"] and rtab.count() == out["presence"].select("gene").distinct().count()
    assert spark.read.text(str(tmp_path / "out" / "final_graph.gml")).count() > 10
    assert spark.read.text(str(tmp_path / "out" / "GFF")).where(F.col("value").contains("\tCDS\t")).count() >= 27


def test_empty(spark):
    none = spark.createDataFrame([], "genome_id long, contig_id long, seq string")
    out = workflow.run(none)
    assert all(df.count() == 0 for df in out.values())


def test_supports_by_mode():
    got = {m: [workflow.cleaning(workflow.Settings(mode=m), n) for n in (4, 100, 1000)] for m in ("strict", "moderate", "sensitive")}
    assert [(c.trailing_support, c.edge_support) for c in got["strict"]] == [(2, 2), (5, 2), (50, 10)]
    assert [(c.trailing_support, c.edge_support) for c in got["moderate"]] == [(2, 2), (2, 2), (10, 10)]
    assert [(c.trailing_support, c.rounds, c.edge_support) for c in got["sensitive"]] == [(2, 0, 0)] * 3
    assert workflow.cleaning(workflow.Settings(trailing_support=7, edge_support=1), 50) == workflow.Cleaning(7, 1000, 1)
    with pytest.raises(ValueError):
        workflow.cleaning(workflow.Settings(mode="lax"), 3)


def test_start_windows_and_stop_frequency(spark, planted):
    from strandloom.operators import calling, orf

    genomes = planted[1]
    contigs = spark.createDataFrame([(g, 0, t) for g, t in enumerate(genomes)] + [(9, 0, None), (9, 1, "TA")], "genome_id long, contig_id long, seq string")
    spots = [(g, 0, d, a, a + 30) for g in (0, 1) for d in (1, -1) for a in (0, 15, 16, 20, len(genomes[g]) - 30, len(genomes[g]) - 46, 100)]
    orfs = spark.createDataFrame(spots, "genome_id long, contig_id long, strand int, start int, end int")
    got = {(r.genome_id, r.strand, r.start): r.window for r in calling.start_windows(contigs, orfs, ["genome_id", "contig_id"], "seq").collect()}
    for g, _, d, a, b in spots:
        t, at = (genomes[g], a) if d > 0 else (revcomp(genomes[g]), len(genomes[g]) - b)
        whole = at >= 16 and at + 19 <= len(t)
        assert got[g, d, a] == ((t[at - 16 : at] + t[at + 3 : at + 19])[::-1] if whole else None)
    n = sum(s[i : i + 3] in S.STOP_CODONS for t in genomes for s in (t, revcomp(t)) for i in range(len(t) - 2))
    assert orf.stop_frequency(contigs, "seq") == pytest.approx(n / sum(2 * (len(t) - 2) for t in genomes))
    assert orf.stop_frequency(contigs.limit(0), "seq") == 0
