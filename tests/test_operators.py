"""Hand-made fixtures for operators that SQL does not state."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import bestpath, calling, cluster, families, genegraph, kmer, matrix, overlap, paths, refind


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_infix(q, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(q, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_infix_distance():
    random.seed(3)
    for _ in range(400):
        q = "".join(random.choices("ACGT", k=random.randint(1, 12)))
        t = "".join(random.choices("ACGT", k=random.randint(0, 25)))
        d, s, e = refind.infix_distance(q, t)
        assert d == plain_infix(q, t)
        # the place it names has that distance
        row = list(range(len(t[s:e]) + 1))
        for i, c in enumerate(q, 1):
            new = [i]
            for j, x in enumerate(t[s:e], 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        assert row[-1] == d
    assert refind.infix_distance("ANGT", "TTACGTTT", refind.DNA_WILD)[0] == 0
    assert refind.infix_distance("AAAA", "TTTT", None, 2) is None


def test_sequence_functions(spark):
    df = spark.createDataFrame([("CCATGAAAGTGTTTTAACCATGA",)], "s string")
    got = df.select(
        S.reverse_complement(F.col("s")), S.translate_to_stop(F.col("s"), 2), S.codon_positions(F.col("s"), ["ATG"]), S.kmers(F.lit("ACGT"), 3),
        S.split_n(F.lit("acnnGTN")), S.isolate_name(F.lit("/a/b.c/x.y.fa")), S.gene_label(F.array(F.lit("a b"), F.lit(""), F.lit("c|d"))), S.back_translate(F.lit("M-K"), F.lit("ATGAAA")),
        S.reverse_path(F.array(F.lit(1), F.lit(-2))), S.best_frame(F.lit("CCATGAAAGTG"), F.lit("MKV")), S.qualifier(F.lit("a;b=c")), S.frame_mask(F.array(F.lit(3), F.lit(5))),
    ).first()
    assert tuple(got) == ("TCATGGTTAAAACACTTTCATGG", "MKVF*", [2, 19], ["ACG", "CGT"], ["AC", "GT"], "x.y", "ab~~~c-d", "ATG---AAA", [2, -1], "MKV", "a_b_c", 5)


def test_coordinates_and_spelling(spark):
    df = spark.createDataFrame([(1, [1, -2, 3], [5, 6, 4])], "id int, nodes array<int>, sizes array<int>")
    ranges = df.withColumn("r", paths.node_ranges(F.col("nodes"), F.col("sizes"), 2))
    assert [tuple(x) for x in ranges.first().r] == [(0, 5), (3, 9), (7, 11)]
    cut = ranges.withColumn("coords", paths.to_nodes(F.lit(1), F.lit(10), F.col("nodes"), F.col("r")))
    assert [tuple(x) for x in cut.first().coords] == [(1, 1, 5), (-2, 0, 6), (3, 0, 3)]
    unitigs = spark.createDataFrame([(1, "ACGTA"), (2, "CCGGTA"), (3, "GGAT")], "node_id int, seq string")
    # node 2 read backwards is TACCGG: it repeats the last two bases of node 1, and node 3 its last two
    assert paths.path_sequence(cut, unitigs, ["id"], 2).first().seq == "CGTACCGGA"
    assert [tuple(x) for x in cut.select(paths.drop_short(F.col("coords"), 3)).first()[0]] == [(1, 1, 5), (-2, 0, 6)]


def test_overlap_types(spark):
    orfs = [(1, 1, 0, 100, 1), (1, 2, 90, 200, 1), (1, 3, 190, 300, -1), (1, 4, 290, 400, 1), (1, 5, 310, 330, -1), (1, 6, 600, 800, 1), (1, 7, 650, 900, 1), (2, 1, 0, 50, 1)]
    got = rows(overlap.classify(spark.createDataFrame(orfs, "key int, orf int, start int, end int, strand int")))
    assert got == sorted([(1, 1, 2, "u", 10), (1, 2, 3, "c", 10), (1, 3, 4, "d", 10), (1, 4, 5, "w", 20), (1, 6, 7, "i", 150)], key=str)


def best_by_trying(ids, start, end, score, rule):
    best = (0.0, [])
    for m in range(1 << len(ids)):
        path = sorted((k for k in range(len(ids)) if m >> k & 1), key=lambda k: (start[k], end[k], ids[k]))
        total, ok = 0.0, True
        for n, k in enumerate(path):
            total += score[k]
            if n:
                j = path[n - 1]
                r = rule.get((ids[j], ids[k]))
                ok &= (r[0] != "i") if r else end[j] <= start[k]
                total -= bestpath.PENALTY.get(r[0], 0) * r[1] if r else 0
        if ok and total > best[0]:
            best = (total, [ids[k] for k in path])
    return best


def test_best_path_against_trying_all():
    random.seed(8)
    for _ in range(60):
        n = random.randint(1, 9)
        start = [random.randrange(300) for _ in range(n)]
        end = [s + random.randrange(30, 120) for s in start]
        score, ids, rule = [random.uniform(20, 200) for _ in range(n)], list(range(n)), {}
        order = sorted(ids, key=lambda k: (start[k], end[k], k))
        for x, a in enumerate(order):
            for b in order[x + 1 :]:
                bp = min(end[a], end[b]) - max(start[a], start[b])
                if bp > 0:
                    rule[a, b] = ("i" if bp > 60 else random.choice("ucdw"), bp)
        path, total = bestpath.heaviest(ids, start, end, score, rule)
        assert total == pytest.approx(best_by_trying(ids, start, end, score, rule)[0])


def test_best_paths_over_keys(spark):
    orfs = spark.createDataFrame([(1, 1, 0, 200, 300.0), (1, 2, 50, 260, 310.0), (1, 3, 250, 400, 200.0), (1, 4, 900, 1000, 150.0), (1, 5, 2000, 2100, 50.0)], "key int, orf long, start int, end int, score double")
    rules = spark.createDataFrame([(1, 1, 2, "i", 150), (1, 2, 3, "u", 10)], "key int, src long, dst long, type string, bp int")
    assert rows(bestpath.best_paths(orfs, rules)) == [(1, 1), (1, 3), (1, 4)]


def test_greedy_clusters_equal_the_sequential_rule(spark):
    random.seed(5)
    base = ["".join(random.choices("ACDEFGHIKLMNPQRSTVWY", k=60)) for _ in range(6)]
    seqs = set()
    for b in base:
        for _ in range(12):
            s = list(b)
            for _ in range(random.randint(0, 3)):
                s[random.randrange(len(s))] = random.choice("ACDEFGHIKLMNPQRSTVWY")
            seqs.add("".join(s)[: random.choice([60, 60, 59])])
    items = spark.createDataFrame([(f"p{i:03}", s) for i, s in enumerate(sorted(seqs))], "item string, seq string").cache()
    nodes = items.select("item", F.explode(F.array_distinct(S.kmers(F.col("seq"), 8))).alias("node"))
    pairs = cluster.centroid_pairs(items, nodes, 0.95, 0.95).cache()
    got = rows(cluster.greedy(items, pairs))
    partner, taken, want = {}, set(), []
    for c, m, _ in pairs.collect():
        partner.setdefault(c, []).append(m)
    for item, seq in sorted(items.collect(), key=lambda r: (-len(r.seq), r.item)):
        if item not in taken:
            own = [item, *sorted(m for m in partner.get(item, []) if m not in taken)]
            taken.update(own)
            want += [(item, m) for m in own]
    assert got == sorted(want, key=str)


def test_scores_are_shared_within_clusters(spark):
    clusters = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")], "centroid string, member string")
    probs = spark.createDataFrame([("a", 0.9), ("c", 0.0)], "centroid string, gene_prob double")
    orfs = spark.createDataFrame([(m, "ATG", 0.5, n) for m, n in (("a", 300), ("b", 297), ("c", 300), ("d", 900))], "member string, start_codon string, tis_prob double, len int")
    got = cluster.share_scores(clusters, probs, orfs, calling.START_WEIGHT, calling.GENE_WEIGHT, calling.TIS_WEIGHT, 1.0, 100.0)
    assert {r.member for r in got.collect()} == {"a", "b"}


def test_choose_starts(spark):
    kind = "id int, frame int, stop int, start int, len int, tis double, site_genomes long, stop_freq double"
    starts = spark.createDataFrame([(1, 0, 300, 0, 303, 0.2, 1, 0.05), (1, 0, 300, 9, 294, 0.9, 5, 0.05), (1, 0, 300, 240, 63, 0.99, 9, 0.05), (2, 0, 90, 0, 93, 0.5, 1, 0.05)], kind)
    assert rows(calling.choose_starts(starts)) == [(1, 0, 300, 9, 294), (2, 0, 90, 0, 93)]


def test_strands_agree(spark):
    orfs = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [-2, -3]), (1, 3, [7])], "genome_id int, orf_id int, nodes array<int>")
    side = {r.node: r.forward for r in calling.strand_consensus(orfs).collect()}
    assert side[1] == side[2] == side[3] and side[7]
    assert rows(calling.strand_votes(orfs, calling.strand_consensus(orfs))) == [(1, 1, side[1]), (1, 2, not side[1]), (1, 3, True)]


def test_gene_graph(spark):
    adj = spark.createDataFrame([("g1", 1, 2), ("g1", 2, 3), ("g2", 2, 1), ("g2", 2, 4), ("g3", 4, 2), ("g3", 4, 4)], "genome string, src long, dst long")
    edges = genegraph.edges_of(adj)
    assert [(u, v, n) for u, v, n, _ in rows(edges)] == [(1, 2, 2), (2, 3, 1), (2, 4, 2)]
    nodes = spark.createDataFrame([(1, 2, True), (2, 3, False), (3, 1, True), (4, 2, False)], "node long, size int, has_end boolean")
    assert [(u, v) for u, v, *_ in rows(genegraph.clean_edges(nodes, edges, 2))] == [(1, 2), (2, 4)]
    cents = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (5, "b"), (9, "c")], "node long, centroid string")
    assert rows(genegraph.merge_paralogs(cents)) == [(1, 1), (2, 1), (5, 1), (9, 9)]
    members = spark.createDataFrame([("x", "g1", 1), ("x", "g1", 2), ("y", "g1", 3)], "cluster string, genome string, orf int")
    assert rows(genegraph.paralogs(members)) == [("x", 2)]
    assert genegraph.split_paralogs(members).select("node").distinct().count() == 3
    merged = genegraph.merge_attributes(spark.createDataFrame([(1, "g1", 1, "MKV", "a", 1.0, False), (2, "g2", 7, "MKVV", "b", 9.0, True)], "node long, genome string, orf int, seq string, annotation string, bitscore double, has_end boolean"), spark.createDataFrame([(1, 1), (2, 1)], "node long, merged long")).first()
    assert (merged.size, tuple(merged.centroid), merged.annotation, merged.description, merged.has_end) == (2, ("g2", 7), "b", "a;b", True)


def test_families(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (3, 7), (4, 8)], "u long, v long")
    near = families.neighbourhoods(edges, spark.createDataFrame([(2,)], "seed long"), 2)
    assert rows(near) == [(2, 1, 1), (2, 2, 0), (2, 3, 1), (2, 4, 1), (2, 5, 2), (2, 7, 2), (2, 8, 2)]
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "a"), (6, "a"), (7, "a"), (8, "a")], "node long, genome string")
    similar = spark.createDataFrame([(3, 4, 0.9), (7, 8, 0.95), (1, 6, 0.5)], "a long, b long, identity double")
    got = dict(rows(families.collapse_families(nodes, edges, similar, 0.7)))
    assert got[3] == got[4] == 3 and got[7] == 7 and got[8] == 8
    copies = spark.createDataFrame([("c", 1, "a"), ("c", 6, "a"), ("c", 7, "b")], "cluster string, node long, genome string")
    assert dict(rows(families.collapse_paralogs(copies, edges)))[7] in (1, 6)
    # two copies of one genome never join the same copy; the nearer goes first
    copies = spark.createDataFrame([("c", 1, "a"), ("c", 6, "a"), ("c", 4, "b"), ("c", 8, "b")], "cluster string, node long, genome string")
    assert dict(rows(families.collapse_paralogs(copies, edges))) == {1: 1, 6: 6, 4: 1, 8: 6}
    # a genome in both is no hindrance if the two lie next to each other in it
    shared = spark.createDataFrame([(1, 2, ["a"]), (2, 3, ["a", "b"]), (3, 4, ["a"]), (2, 5, ["b"]), (3, 5, ["b"])], "u long, v long, genomes array<string>")
    nodes = spark.createDataFrame([(2, "a"), (3, "a"), (2, "b"), (3, "b"), (5, "b"), (1, "a"), (4, "a")], "node long, genome string")
    alike = spark.createDataFrame([(2, 3, 0.9)], "a long, b long, identity double")
    assert dict(rows(families.collapse_families(nodes, shared, alike, 0.7)))[3] == 2
    assert dict(rows(families.collapse_families(nodes, shared.withColumn("genomes", F.array(F.lit("a"))), alike, 0.7)))[3] == 3
    orfs = spark.createDataFrame([("a", 0, 1, 0, 100), ("a", 0, 2, 150, 300), ("a", 0, 3, 20000, 20100), ("a", 1, 4, 0, 90)], "genome string, contig_id int, orf int, start int, end int")
    assert rows(families.connect_orfs(orfs)) == [("a", 1, 2)]


def test_refinding(spark):
    random.seed(2)
    gene = "ATG" + "".join(random.choices("ACGT", k=87)) + "TAA"
    flank = ["".join(random.choices("ACGT", k=200)) for _ in range(3)]
    lost = gene[:40] + "A" + gene[41:]
    contig = flank[0] + lost.translate(str.maketrans("ACGT", "TGCA"))[::-1] + flank[1] + "ATGAAATAA" + flank[2]
    contigs = spark.createDataFrame([("g", 0, contig)], "genome string, contig_id int, seq string")
    genes = spark.createDataFrame([(2, "g", 0, 493, 502)], "node long, genome string, contig_id int, start int, end int")
    searches = spark.createDataFrame([(1, 2, "g")], "node long, neighbour long, genome string")
    window = refind.windows(searches, genes, contigs, 400)
    assert "N" * 9 in window.first().seq
    cents = spark.createDataFrame([(1, gene, "x")], "node long, dna string, protein string").withColumn("protein", S.translate_to_stop(F.col("dna")))
    hit = refind.refind(window, cents).first()
    assert (hit.start, hit.end, hit.reverse, hit.dna, hit.orf_id) == (200, 200 + len(gene), True, lost, -1)
    place = refind.located(spark.createDataFrame([("g", 5, gene[:40]), ("g", 6, flank[1])], "genome string, orf_id int, dna string"), contigs)
    assert (("g", 6, 0, 294, False)) in rows(place)


def test_search_and_postings(spark):
    orfs = spark.createDataFrame([(0, 1, [1, -2]), (1, 4, [2])], "genome_id int, orf_id int, nodes array<int>")
    found = spark.createDataFrame([("q1", 2), ("q2", -2), ("q3", 9)], "query_id string, node int")
    assert rows(kmer.orfs_of_queries(found, kmer.node_index(orfs))) == [(0, 1, ["q1", "q2"]), (1, 4, ["q1", "q2"])]
    q = spark.createDataFrame([("a", "ACGTAC"), ("b", "TTTTTT")], "query_id string, seq string")
    t = spark.createDataFrame([(1, "GGACGTACGG"), (2, "ACGA")], "id int, seq string")
    assert rows(kmer.search(q, t, 4, 0.8)) == [("a", 1, 3, 3)]


def test_iupac_and_power_law(spark):
    aligned = spark.createDataFrame([(1, "ACGT-N"), (2, "RCTTAC"), (3, "YGGAAC")], "id int, seq string")
    assert rows(matrix.snp_distances(aligned)) == [(1, 2, 1), (1, 3, 3), (2, 3, 4)]
    curve = spark.createDataFrame([(i, 100.0 * i**-0.5) for i in range(1, 30)], "step int, new_genes double")
    a, b, err = matrix.power_law(curve)
    assert a == pytest.approx(100, rel=1e-4) and b == pytest.approx(-0.5, rel=1e-4) and err < 1e-3
    named = matrix.gene_names(spark.createDataFrame([(1, ["abc"]), (2, ["abc"]), (3, [""])], "cluster_id int, annotations array<string>"))
    assert rows(named) == [(1, "abc"), (2, "group_2"), (3, "group_3")]
