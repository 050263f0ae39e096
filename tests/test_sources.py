"""Files in and text out."""

import gzip

from strandloom.sources import fasta, tables


def test_fasta_fastq_and_queries(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first one\nacgt\nAC\n>c2\nGGNN\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nTTT\n")
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    got = fasta.read_fasta(spark, [str(tmp_path / n) for n in ("a.fa", "b.fa.gz", "r.fq")])
    assert sorted((r.id, r.record, r.description, r.seq) for r in got.collect()) == [("c1", 0, "first one", "ACGTAC"), ("c2", 1, "", "GGNN"), ("r1", 0, "x", "ACGT"), ("r2", 1, "", "GG"), ("z", 0, "", "TTT")]
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa.gz\n")
    assert [(r.genome_id, r.isolate) for r in fasta.read_paths(spark, str(tmp_path / "list.txt")).collect()] == [(0, "a"), (1, "b.fa")]
    (tmp_path / "q.txt").write_text("acg\n\nTTT\n")
    assert [r.seq for r in fasta.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["ACG", "TTT"]
    assert fasta.read_queries(spark, str(tmp_path / "a.fa")).count() == 2


def test_hits_gfa_and_text(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("q\th\t55.5\tsome title\n")
    assert tuple(tables.read_diamond(spark, str(tmp_path / "d.tsv")).first()) == ("q", "h", 55.5, "some title")
    (tmp_path / "h.tbl").write_text("# comment\nhit - query - 1e-5 44.0 0.1 1e-5 43 0 1 1 0 0 1 1 1 1 a long title\n")
    assert tuple(tables.read_hmmer(spark, str(tmp_path / "h.tbl")).first()) == ("query", "hit", 44.0, "a long title")
    nodes = spark.createDataFrame([(1, "ACGT"), (2, "GTTT")], "node_id int, seq string")
    links = spark.createDataFrame([(1, -2)], "src int, dst int")
    tables.gfa_lines(nodes, links, 2).coalesce(1).write.text(str(tmp_path / "gfa"))
    seg, lin = tables.read_gfa(spark, str(tmp_path / "gfa"))
    assert sorted(map(tuple, seg.collect())) == [("1", "ACGT", None), ("2", "GTTT", None)] and tuple(lin.first()) == ("1", "+", "2", "-", "2M")
    genes = spark.createDataFrame([("i", "c1", 5, 9, "+", "x;1", "n", "p=q"), ("i", "c1", 1, 4, "-", "y", "m", "r")], "isolate string, contig string, start int, end int, strand string, id string, name string, product string")
    text = tables.gff3_lines(genes).first().value.split("\n")
    assert text[0] == "##gff-version 3" and text[1].startswith("c1\tstrandloom\tCDS\t1\t4") and "ID=x_1;gene=n;product=p_q" in text[2]
    ffn = fasta.gene_fasta(spark.createDataFrame([("i", 3, 7, "ann", True, "ACG", "T")], "isolate string, orf_id int, cluster int, annotation string, pseudo boolean, dna string, protein string"))
    assert ffn.first().value == ">i_3 cluster=7 ann(pseudogene)\nACG"


def test_matrices_trees_and_alignments(spark):
    d = spark.createDataFrame([("a", "b", 2), ("a", "c", 4), ("b", "c", 4)], "a string, b string, distance int")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert sorted(r.value for r in tables.phylip_lines(d, names).collect()) == ["a\t0\t2\t4", "b\t2\t0\t4", "c\t4\t4\t0"]
    tree = tables.neighbour_joining(list("abcd"), [[0, 3, 8, 9], [3, 0, 9, 10], [8, 9, 0, 7], [9, 10, 7, 0]])
    assert "a:1,b:2" in tree and tree.endswith(";")
    aligned = spark.createDataFrame([("g1", "a", "AC-T"), ("g1", "b", "ACGA"), ("g1", "b", "AC--"), ("g2", "a", "TT")], "gene string, id string, seq string")
    whole, places = tables.core_alignment(aligned, spark.createDataFrame([("g1",), ("g2",)], "gene string"), names)
    assert sorted(map(tuple, whole.collect())) == [("a", "AC-TTT"), ("b", "ACGA--"), ("c", "------")]
    assert sorted(map(tuple, places.collect())) == [("g1", 1, 4), ("g2", 5, 6)]
    v = tables.variants(aligned.where("gene = 'g1' AND seq <> 'AC--'"))
    assert [tables.vcf_lines(v).first().value] == ["g1\t4\t.\tT\tA\t.\t.\t.\tGT\t0\t1"]
    gml = [r.value for r in tables.gml_lines(spark.createDataFrame([(1, "x", 2)], "node int, label string, size int"), spark.createDataFrame([(1, 2, 3)], "u int, v int, n_genomes int")).orderBy("part").collect()]
    assert gml[0] == "graph [" and gml[-1] == "]" and 'label "x"' in gml[1]
