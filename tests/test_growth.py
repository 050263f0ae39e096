"""Steps that must not grow faster than their input, and ties that must not depend on how rows lie in files."""

from strandloom.operators import genegraph
from strandloom.plans import all_queries


def test_missing_neighbours_of_full_nodes_make_no_rows(spark):
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)], "u long, v long")
    members = spark.createDataFrame([(n, g) for n in range(6) for g in [*range(70), None] if (n, g) not in ((2, 3), (4, 69))], "node long, genome int")
    found = genegraph.missing_neighbours(edges, members)
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each genome of each edge
    want = [(2, n, 3) for n in range(6) if n != 2] + [(4, n, 69) for n in range(6) if n != 4] + [(a, b, None) for a in range(6) for b in range(6) if a != b]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_lines_of_one_number_in_any_file_order(spark, tmp_path):
    rows = [(1, 1, s, f"1995-{s:02d}-01") for s in (5, 2, 9, 4, 7, 1)] + [(2, 1, 3, "1996-01-01"), (2, 2, 5, "1996-02-01")]
    got = []
    for name, order in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(order, "l_orderkey long, l_linenumber int, l_suppkey long, d string").selectExpr("*", "CAST(d AS timestamp) AS l_shipdate").coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        got.append(sorted(map(tuple, all_queries()["missing_neighbours"](spark, str(tmp_path / name)).collect())))
    assert got[0] and got[0] == got[1]


def test_variants_of_a_hub_are_paired_by_bits(spark):
    import random

    rng = random.Random(3)
    dense = [(min(0, n), max(0, n), [f"g{k}" for k in range(70) if rng.random() < 0.7]) for n in range(1, 40)]
    sparse = [(100, 100 + n, [f"g{n % 35}", f"g{35 + n % 35}"]) for n in range(1, 70)]
    edges = [(u, v, len(g), sorted(g)) for u, v, g in dense + sparse + [(1, 2, ["g0", "g1"])]]
    found = genegraph.structural_variants(spark.createDataFrame(edges, "u long, v long, n_genomes int, genomes array<string>"), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan  # pairs of a hub are not shuffled once a genome
    at = {}
    for u, v, _, g in edges:
        at.setdefault(u, {})[v] = set(g)
        at.setdefault(v, {})[u] = set(g)
    want = {(n, a, b, len(m[a] & m[b])) for n, m in at.items() if len(m) > 2 for a in m for b in m if a < b and len(m[a] & m[b]) > 1}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want and any(n == 100 for n, *_ in want)


def test_located_orfs_of_a_repeated_line(spark):
    import random

    from strandloom.operators import refind

    rng = random.Random(8)
    line, tail = "".join(rng.choice("ACGT") for _ in range(60)), "".join(rng.choice("ACGT") for _ in range(50))
    seq = tail[:20] + line * 50 + tail
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cut = [seq[20 + 60 * i : 20 + 60 * i + 45] for i in range(50)] + [seq[20 + 60 * i :] for i in range(50)] + [flip(seq[700:790]), "ACGTTGCA" * 9, seq[5:12]]
    contigs = spark.createDataFrame([(1, 0, seq), (1, 1, "AC" + seq), (2, 0, tail)], "genome int, contig_id int, seq string")
    orfs = spark.createDataFrame([(1, i, x) for i, x in enumerate(cut)], "genome int, orf_id int, dna string")
    found = refind.located(orfs, contigs)
    assert "filter(o" not in found._jdf.queryExecution().optimizedPlan().toString()  # no list of a contig's ORFs
    want = {(i, 0, seq.find(x) + 1, False) if x in seq else (i, 0, seq.find(flip(x)) + 1, True) for i, x in enumerate(cut) if x in seq or flip(x) in seq}
    assert {(r.orf_id, r.contig_id, r.start, r.reverse) for r in found.collect()} == want and len(want) == 102


def test_a_dense_graph_is_not_walked(spark, monkeypatch):
    from strandloom.operators import families

    def walked(*_):
        raise AssertionError("pairs next to each other need no walk")

    monkeypatch.setattr(families, "neighbourhoods", walked)
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)] + [(10, 11), (11, 12)], "u long, v long")
    nodes = spark.createDataFrame([(n, n) for n in [*range(6), 10, 11, 12]], "node long, genome int")
    similar = spark.createDataFrame([(0, 1, 0.9), (2, 3, 0.9), (4, 11, 0.9)], "a long, b long, identity double")
    got = {r.node: r.merged for r in families.collapse_families(nodes, edges, similar, 0.7, depths=(1,)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 10: 10, 11: 11, 12: 12}


def test_pairs_that_share_a_genome_are_not_looked_for(spark, monkeypatch):
    from strandloom.operators import families

    def looked(*_):
        raise AssertionError("no pair can merge")

    monkeypatch.setattr(families, "near_pairs", looked)
    edges = spark.createDataFrame([(0, n) for n in range(1, 6)], "u long, v long")  # all beside a hub
    nodes = spark.createDataFrame([(n, g) for n in range(6) for g in (n, n + 1, 99)], "node long, genome int")
    similar = spark.createDataFrame([(a, b, 0.9) for a in range(6) for b in range(a + 1, 6)], "a long, b long, identity double")
    for e in (edges, edges.selectExpr("*", "array(0) AS genomes")):
        assert {r.node: r.merged for r in families.collapse_families(nodes, e, similar, 0.7).collect()} == {n: n for n in range(6)}


def _families(nodes, edges, similar, depths):
    """Groups by plain loops; edges are {(u, v): genomes, or None if none are kept}."""
    group, has = {n: n for n, _ in nodes}, {}
    for depth in depths:
        has = {n: {g for x, g in nodes if group[x] == n and g is not None} for n in group.values()}
        beside, next_to = {}, {}
        for (u, v), g in edges.items():
            if (e := tuple(sorted((group[u], group[v]))))[0] != e[1]:
                beside.setdefault(e, set()).update(g or ())
                next_to.setdefault(e[0], set()).add(e[1])
                next_to.setdefault(e[1], set()).add(e[0])
        best = {}
        for a, b, x in similar:
            if x >= 0.7 and (e := tuple(sorted((group[a], group[b]))))[0] != e[1]:
                best[e] = max(x, best.get(e, 0))
        near = {}
        for n in group.values():
            near[n] = {n}
            for _ in range(depth):
                near[n] |= {y for x in near[n] for y in next_to.get(x, ())}
        busy = {n for n, x in next_to.items() if len(x) > 2}
        root = {n: n for n in group.values()}
        for (a, b), _ in sorted(((e, x) for e, x in best.items() if near[e[0]] & near[e[1]] & busy), key=lambda t: (-t[1], *t[0])):
            allowed = beside.get((a, b), set())
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b and has[a] & has[b] <= allowed:
                root[max(a, b)], has[min(a, b)] = min(a, b), has[a] | has[b]
        for n in group:
            group[n] = root[group[n]]
            while root[group[n]] != group[n]:
                group[n] = root[group[n]]
    return group


def test_families_as_by_plain_loops(spark):
    import random

    from strandloom.operators import families

    rng, merged = random.Random(12), 0
    for case in range(2):
        nodes = sorted({(n, rng.choice([None, *range(130)])) for n in range(50) for _ in range(rng.choice((1, 2, 9)))}, key=str)
        pairs = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(55)}
        edges = {e: sorted(rng.sample(range(130), 60)) if case % 2 else None for e in pairs}
        similar = [(*sorted(rng.sample(range(50), 2)), rng.choice((0.6, 0.7, 0.8, 0.9))) for _ in range(150)]
        kept = "u long, v long" + ", genomes array<int>" * (case % 2)
        e = spark.createDataFrame([(u, v, g)[: 2 + case % 2] for (u, v), g in edges.items()], kept)
        found = families.collapse_families(spark.createDataFrame(nodes, "node long, genome int"), e, spark.createDataFrame(similar, "a long, b long, identity double"), 0.7)
        want = _families(nodes, edges, similar, (1, 2, 3))
        assert dict(map(tuple, found.collect())) == want and found.count() == len(want)
        merged += sum(n != m for n, m in want.items())
    assert merged > 10


def test_orfs_are_found_in_arrays(spark):
    import random

    from pyspark.sql import functions as F

    from strandloom.functions.sequence import dna
    from strandloom.operators.orf import orf_pairs

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  \nÀé\U0001f600ABYZ") for _ in range(rng.choice((0, 3, 9, 400, 4000)))) for _ in range(40)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    direct = orf_pairs(rows, "id", "text", 30, with_dna=True, prose=True)
    assert "regexp" not in direct._jdf.queryExecution().optimizedPlan().toString()  # neither recoded nor cut by patterns
    recoded = rows.select("id", dna(F.col("text")).alias("seq"))
    got = sorted(map(tuple, direct.collect()))
    assert got == sorted(map(tuple, orf_pairs(recoded, "id", "seq", 30, with_dna=True).collect())) and len(got) > 50
    want = []
    for i, seq in map(tuple, recoded.where("seq IS NOT NULL").collect()):
        for b in range(len(seq) - 2):
            stop = next((p for p in range(b, len(seq) - 2, 3) if seq[p : p + 3] in ("TAA", "TGA", "TAG")), None)
            if seq[b : b + 3] in ("ATG", "GTG", "TTG") and stop is not None and stop + 3 - b >= 30:
                want.append((i, b % 3, b, stop, stop + 3 - b, seq[b : stop + 3]))
    assert got == sorted(want)


def test_short_stretches_share_batches(spark):
    import random

    from strandloom.operators import bestpath

    rng = random.Random(6)
    orfs, overlaps = [], []
    for n in range(3000):  # a key each thousand, a stretch each pair
        key, at, lap = "abc"[n // 1000], 500 * (n % 1000), rng.randrange(1, 60)
        orfs += [(key, 2 * n, at, at + 100, 200.0), (key, 2 * n + 1, at + 100 - lap, at + 200, 200.0 + 2 * lap)]
        overlaps.append((key, 2 * n, 2 * n + 1, "i" if n % 7 == 0 else "u", lap))
    o = spark.createDataFrame(orfs, "key string, orf long, start int, end int, score double")
    l = spark.createDataFrame(overlaps, "key string, src long, dst long, type string, bp int")
    found = bestpath.best_paths(o, l)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # no call for each stretch
    want = {(k, x) for k, a, b, kind, lap in overlaps for x in ((a, b) if kind == "u" and 3.895921717182765 * lap < 200 else (b,))}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # stretches that go on in the next batch
    try:
        assert {tuple(r) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _canonical(seq, k):
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return [min(seq[i : i + k], flip(seq[i : i + k])) for i in range(len(seq) - k + 1) if set(seq[i : i + k]) <= set("ACGT")]


def test_genomes_of_kmers_as_bits(spark, monkeypatch):
    import random

    from strandloom.operators import kmer

    rng = random.Random(4)
    rows = [(None if n == 7 else n % 150, "".join(rng.choice("ACGTN" if n % 9 == 0 else "AC") for _ in range(rng.choice((2, 30))))) for n in range(300)]
    want = {}
    for g, seq in rows:
        for x in _canonical(seq, 4):
            want.setdefault(x, set()).update([] if g is None else [g])
    number = lambda x: int(x.translate(str.maketrans("ACGT", "0123")), 4)
    monkeypatch.setattr(kmer, "WORDS", 1)  # tables are given up and begun again
    found = kmer.genomes_of_kmers(spark.createDataFrame(rows, "g int, seq string"), "g", "seq", 4)
    assert {tuple(r) for r in found.collect()} == {(number(x), len(g)) for x, g in want.items()}


def test_kmers_are_counted_as_numbers(spark):
    from collections import Counter

    from strandloom.operators import dbg

    refs, reads = ["ACGTTGCATTACGNNACGTTACG", "", "ACG"], ["TTGCATTAAAAAAAAA", "CCGGATTAC", "é" + "ACGTTG"]
    c = Counter(x for s in reads for x in _canonical(s, 5))
    want = Counter(x for s in refs for x in _canonical(s, 5)) + Counter({x: n for x, n in c.items() if n > 1})
    table = lambda t: spark.createDataFrame([(s,) for s in t] + [(None,)], "seq string")
    got = dbg.counts_of(table(refs), table(reads), 5)
    assert dict(map(tuple, got.collect())) == dict(want) and got.count() == len(want)


def test_pairs_that_share_one_node_make_no_rows(spark):
    import random
    from collections import Counter

    from strandloom.operators import overlap

    rng = random.Random(2)
    rows = [(n, rng.randrange(40)) for n in range(60) for _ in range(rng.choice((1, 2, 4, 30)))] + [(1, None), (None, 1)]
    table = spark.createDataFrame(rows, "item int, node int")
    want = dict(Counter(r.n_shared for r in overlap.shared_pairs(table, "item", "node").collect()))
    for most in (64, 10, 0):
        assert dict(map(tuple, overlap.shared_counts(table, "item", "node", most).collect())) == want
    apart = spark.createDataFrame([(n, 0) for n in range(3000)], "item int, node int")
    assert list(map(tuple, overlap.shared_counts(apart, "item", "node").collect())) == [(1, 3000 * 2999 // 2)]


def test_ends_are_trimmed_by_degrees(spark, monkeypatch):
    import random

    from strandloom import session

    rng, names, write = random.Random(7), [], session.written
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(70)} | {(100 + n, 101 + n) for n in range(9)}
    size = {n: rng.choice((1, 1, 1, 5)) for n in [*range(80), *range(100, 110)]}
    monkeypatch.setattr(genegraph, "written", lambda df, name: names.append(name) or write(df, name))
    for rounds in (0, 1, 3, 1000):
        left, links = set(size), set(pairs)
        for _ in range(rounds):
            gone = {n for n in left if size[n] < 3 and sum(n in e for e in links) <= 1}
            left, links = left - gone, {e for e in links if not gone & set(e)}
        names.clear()
        nodes, edges = genegraph.trim_ends(spark.createDataFrame(list(size.items()), "node long, size int"), spark.createDataFrame(sorted(pairs), "u long, v long"), 3, rounds)
        assert {r.node for r in nodes.collect()} == left and {tuple(r) for r in edges.collect()} == links
        assert names.count("edges") == 1  # rounds write what changes, not the edges


def test_genomes_of_edges_as_bits(spark):
    import random

    rng = random.Random(9)
    for n in (3, 70, 600):  # the last in too many words
        rows = [(rng.choice([None, *(f"g{i}é" for i in range(n))]), rng.randrange(9), rng.randrange(9)) for _ in range(900)] + [(None, 20, 21)]
        want = {}
        for g, a, b in rows:
            if a != b:
                want.setdefault((min(a, b), max(a, b)), set()).update([] if g is None else [g])
        steps = spark.createDataFrame(rows, "genome string, src int, dst int")
        for found in (genegraph.edges_of(steps, steps.select("genome")), genegraph.edges_of(steps)):
            assert {(r.u, r.v): (r.n_genomes, r.genomes) for r in found.collect()} == {k: (len(g), sorted(g)) for k, g in want.items()}


def test_words_of_proteins_are_numbers(spark):
    import random

    import pytest
    from pyspark.sql import functions as F

    from strandloom.functions.sequence import kmers
    from strandloom.operators import cluster

    rng, seqs = random.Random(10), {"", "MKV*"}
    for _ in range(12):
        base = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.choice((9, 40, 70)))) + "*"
        for _ in range(15):
            s = list(base)
            for _ in range(rng.randint(0, 4)):
                s[rng.randrange(len(s))] = rng.choice("ACDEFX")
            seqs.add("".join(s)[rng.choice((0, 0, 1, 3, 20)) :])
    items = spark.createDataFrame([(f"p{i:03}", s) for i, s in enumerate(rng.sample(sorted(seqs), len(seqs)))], "item string, seq string")
    nodes = items.select("item", F.explode(F.array_distinct(kmers(F.col("seq"), 5))).alias("node"))
    found = cluster.protein_pairs(items, 5, 0.8, 0.85)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "min_by" not in plan  # words go once, as numbers
    got = sorted(map(tuple, found.collect()))
    # by plain loops: the longest item with each word takes part in all its pairs
    of, first = {r.item: r.seq for r in items.collect()}, {}
    for item, seq in sorted(of.items(), key=lambda t: (-len(t[1]), t[0])):
        for i in range(len(seq) - 4):
            first.setdefault(seq[i : i + 5], item)
    pairs = {(first[s[i : i + 5]], m) for m, s in of.items() for i in range(len(s) - 4)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(c, m): edits(of[c], of[m]) for c, m in pairs if c != m and len(of[m]) >= 0.8 * len(of[c])}
    want = sorted((c, m, 1 - d / len(of[c])) for (c, m), d in want.items() if d <= int((1 - 0.85) * len(of[c]) + 1e-9))
    assert [(c, m, round(x, 9)) for c, m, x in got] == [(c, m, round(x, 9)) for c, m, x in want] and len(got) > 30
    assert sorted(map(tuple, cluster.centroid_pairs(items, nodes, 0.8, 0.85).collect())) == got
    with pytest.raises(Exception, match="letters and"):
        cluster.protein_pairs(spark.createDataFrame([("a", "MK1V")], "item string, seq string"), 3).collect()


def test_frames_are_translated_once(spark):
    from pyspark.sql import functions as F

    from strandloom.functions.sequence import translate_to_stop
    from strandloom.operators.orf import orf_pairs

    rows = spark.createDataFrame([(1, "CCATGAAAGTGTTTNACTAACCATGATTGAAAATAGC"), (2, "ATGTGATTGCCCTAA"), (3, "GTGé€GTTGTAATGA")], "id int, seq string")
    found = orf_pairs(rows, "id", "seq", 6, with_dna=True, with_protein=True).select("protein", translate_to_stop(F.col("dna")).alias("want")).collect()
    assert found and all(r.protein == r.want for r in found)


def test_stops_of_both_strands(spark):
    from pyspark.sql import functions as F

    from strandloom.functions.sequence import translate_to_stop
    from strandloom.operators import orf

    seqs = ["ATGTAACTATTATGA", "TTATCANNTAG", "TA", "", None, "é€TAATCA"]
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = [x for s in seqs if s is not None for x in (s, flip(s))]
    want = sum(x[i : i + 3] in ("TAA", "TGA", "TAG") for x in texts for i in range(len(x) - 2)) / sum(max(len(x) - 2, 0) for x in texts)
    table = spark.createDataFrame([(s,) for s in seqs], "seq string")
    assert orf.stop_frequency(table, "seq") == want and orf.stop_frequency(table.limit(0), "seq") == 0.0
    both = table.select(orf.protein_to_stop("seq").alias("x"), translate_to_stop(F.col("seq")).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both]


def test_copies_are_matched_in_batches(spark):
    import random

    from strandloom.operators import families

    rng, copies = random.Random(11), []
    for n in range(120):
        copies.append((f"c{n % 7}", n, f"g{rng.randrange(5)}"))
    edges = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(140)})
    table, links = spark.createDataFrame(copies, "cluster string, node long, genome string"), spark.createDataFrame(edges, "u long, v long")
    found = families.collapse_paralogs(table, links, 3)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # no call for each genome and cluster
    next_to = {n: {x for e in edges if n in e for x in e} - {n} for _, n, _ in copies}
    dist = {}
    for n in next_to:
        at = {n: 0}
        for d in (1, 2, 3):
            for x in [x for x in at if at[x] == d - 1]:
                for y in next_to[x]:
                    at.setdefault(y, d)
        dist[n] = at
    merged = dict(map(tuple, found.collect()))
    assert found.count() == len(merged)
    of = {}
    for c, n, g in copies:
        of.setdefault(c, {}).setdefault(g, []).append(n)
    for c, genomes in of.items():
        ref = next(g for g, x in genomes.items() if merged[x[0]] == x[0] and len(x) == max(map(len, genomes.values())))
        assert all(merged[n] == n for n in genomes[ref])
        for g in genomes:
            if g != ref:
                pairs = [(dist[a].get(b, 4), -round(sum(1 / (1 + abs(d - dist[b][x])) for x, d in dist[a].items() if d and dist[b].get(x)), 9), a, b) for a in genomes[g] for b in genomes[ref]]
                want = {}
                for _, _, a, b in sorted(pairs):
                    if a not in want and b not in want.values():
                        want[a] = b
                assert {n: merged[n] for n in genomes[g] if n in merged} == want


def test_only_what_is_missing_is_located_on_the_other_strand(spark, monkeypatch):
    import random

    from strandloom.operators import refind

    rng, asked, look = random.Random(13), [], refind._first_places
    monkeypatch.setattr(refind, "_first_places", lambda a, *rest: asked.append(a.count()) or look(a, *rest))
    seq = "".join(rng.choices("ACGT", k=400))
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contigs = spark.createDataFrame([(1, 0, seq), (1, 1, "é" + seq[100:])], "genome int, contig_id int, seq string")
    here = [seq[i : i + 40] for i in (0, 90, 120)] + [None]
    for cut, calls in ((here, [3]), ([*here, flip(seq[50:99]), flip(seq[300:320]), "ACGT" * 20], [6, 3])):
        asked.clear()
        orfs = spark.createDataFrame([(1, i, x) for i, x in enumerate(cut)], "genome int, orf_id int, dna string")
        got = {r.orf_id: (r.contig_id, r.start, r.reverse) for r in refind.located(orfs, contigs).collect()}
        want = {i: (0, seq.find(x) + 1, False) if x in seq else (0, seq.find(flip(x)) + 1, True) for i, x in enumerate(cut) if x and (x in seq or flip(x) in seq)}
        assert got == want and asked == calls


def test_genomes_of_weak_edges_are_not_written(spark, tmp_path, monkeypatch):
    from strandloom.plans import graph_queries

    tables, write = [], graph_queries.written
    monkeypatch.setattr(graph_queries, "written", lambda df, name: tables.append(write(df, name)) or tables[-1])
    texts = [(n, f"s{n:02}", "hub one hub two hub" + " few" * (n < 13) + " lone" * (n == 3)) for n in range(15)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, all_queries()["structural_variants"](spark, str(tmp_path)).collect()))
    assert got == [("hub", "one", "two", 15)]
    assert {(r.u, r.v): r.genomes and len(r.genomes) for r in tables[0].collect()} == {("hub", "one"): 15, ("hub", "two"): 15, ("few", "hub"): None, ("few", "lone"): None}
