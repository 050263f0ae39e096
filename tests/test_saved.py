"""Saved tables, codon files, GML and coloured GFA read back."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import bestpath, orf
from strandloom.sources import saved, tables


def test_schemas_are_checked(spark, tmp_path):
    good = spark.createDataFrame([(1, 2, "ACG", 5, "more")], "genome_id int, orf_id long, dna string, score int, note string")
    saved.save(good, "orfs", str(tmp_path / "orfs"))
    back = saved.load(spark, "orfs", str(tmp_path / "orfs"))
    assert [tuple(r) for r in back.select("genome_id", "orf_id", "dna", "score", "note").collect()] == [(1, 2, "ACG", 5.0, "more")]
    assert saved.load(spark, "orfs", str(tmp_path / "orfs")).where("genome_id = 7").count() == 0
    for bad in (good.drop("dna"), good.withColumn("orf_id", F.lit("x")), good.withColumn("dna", F.lit(1))):
        with pytest.raises(ValueError):
            saved.checked(bad, "orfs")
    empty = spark.createDataFrame([], "cluster_id long, genome_id long, orf_id long")
    saved.save(empty, "clusters", str(tmp_path / "clusters"))
    assert saved.load(spark, "clusters", str(tmp_path / "clusters")).count() == 0


def test_files_do_not_grow_with_genomes(spark, tmp_path):
    saved.save(spark.range(2000).selectExpr("id AS genome_id", "id * 10 AS orf_id", "'ACG' AS dna", "1.0 AS score"), "orfs", str(tmp_path / "orfs"))
    assert len(list((tmp_path / "orfs").rglob("*.parquet"))) <= 200
    back = saved.load(spark, "orfs", str(tmp_path / "orfs"))
    assert back.count() == 2000 and [r.orf_id for r in back.where("genome_id = 1234").collect()] == [12340]


def test_codon_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"codons": {\n "start": ["ATG"],\n "stop": ["TAA", "TAG"]}}')
    (tmp_path / "b.json").write_text('{"codons": {"start": ["CTG"]}}')
    assert orf.read_codons(spark, str(tmp_path / "a.json")) == (("ATG",), ("TAA", "TAG"))
    assert orf.read_codons(spark, str(tmp_path / "b.json")) == (("CTG",), orf.STOP_CODONS)


def test_gml_and_colours(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 'a "b] c', 2, [3, 4]), (2, None, 0, [])], "node int, label string, size int, lengths array<int>")
    edges = spark.createDataFrame([(1, 2, 5)], "u int, v int, n_genomes int")
    tables.gml_lines(nodes, edges).orderBy("part").select("value").coalesce(1).write.text(str(tmp_path / "gml"))
    n, e = tables.read_gml(spark, str(tmp_path / "gml"))
    assert sorted((r.id, r.attributes["label"], r.attributes["size"], r.attributes["lengths"]) for r in n.collect()) == [("1", 'a "b] c', "2", "[3, 4]"), ("2", "", "0", "[]")]
    assert [(r.source, r.target, r.attributes) for r in e.collect()] == [("1", "2", {"size": "5"})]
    coloured = spark.createDataFrame([(1, "ACGT", "0,2"), (2, "GT", None)], "node_id int, seq string, genomes string")
    tables.gfa_lines(coloured, spark.createDataFrame([(1, -2)], "src int, dst int"), 2).write.text(str(tmp_path / "gfa"))
    seg, _ = tables.read_gfa(spark, str(tmp_path / "gfa"))
    assert sorted(map(tuple, seg.collect())) == [("1", "ACGT", ["0", "2"]), ("2", "GT", None)]


def test_orfs_with_their_sequence(spark):
    seqs = spark.createDataFrame([(1, "CCATGAAAGTGTTTTAACCATGA" * 5), (2, "ATG"), (3, None)], "id int, seq string")
    plain, cut = orf.orf_pairs(seqs, "id", "seq", 9), orf.orf_pairs(seqs, "id", "seq", 9, with_dna=True)
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r)[:5] for r in cut.collect())
    text = {r.id: r.seq for r in seqs.collect()}
    assert all(r.dna == text[r.id][r.start : r.start + r.len] for r in cut.collect())


def test_a_long_stretch_is_solved_in_one_sweep():
    n = 20_000
    start = [10 * i for i in range(n)]
    path, total = bestpath.heaviest(list(range(n)), start, [s + 11 for s in start], [20.0] * n, {(i, i + 1): ("u", 1) for i in range(n - 1)})
    assert len(path) == n and total == pytest.approx(20.0 * n - bestpath.PENALTY["u"] * (n - 1))


def test_orfs_of_overlapping_frames_and_long_pieces(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 700))) for _ in range(60)] + ["ATG" * 5000 + "TAA", "ATGTAA", "ATGTA", "A" * 50, "ATG\n" * 20 + "TAA", None]
    want = set()
    for i, t in enumerate(texts):
        for p in range(len(t or "") - 2):
            if t[p : p + 3] in orf.START_CODONS and i != 60:
                stop = next((q for q in range(p, len(t) - 2, 3) if t[q : q + 3] in orf.STOP_CODONS), None)
                if stop is not None and stop + 3 - p >= 30:
                    want.add((i, p % 3, p, stop, stop + 3 - p, t[p : stop + 3]))
    got = [tuple(r) for r in orf.orf_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, seq string"), "id", "seq", 30, with_dna=True).collect()]
    assert len(got) == len(set(got)) and {r for r in got if r[0] != 60} == want
    assert sorted(r[2] for r in got if r[0] == 60) == list(range(0, 15003 - 29, 3))[: 5000 - 8]
