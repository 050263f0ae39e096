"""Unitigs and genome paths: what they spell, against chains found with plain loops."""

import random
from collections import Counter, defaultdict

from strandloom.operators import dbg


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_unitigs(seqs, k):
    links, nodes = defaultdict(set), set()
    for s in seqs:
        ks = [s[i : i + k] for i in range(len(s) - k + 1)]
        for x in ks:
            nodes.add(min(x, rc(x)))
        for x, y in zip(ks, ks[1:]):
            a, b = (min(x, rc(x)), 1 if x <= rc(x) else -1), (min(y, rc(y)), 1 if y <= rc(y) else -1)
            links[a].add((b[0], -b[1]))
            links[b[0], -b[1]].add(a)

    def nxt(node, side):
        if len(links[node, side]) != 1:
            return None
        (o, os), = links[node, side]
        return (o, -os) if len(links[o, os]) == 1 and o != node else None

    seen, out = set(), []
    for n in sorted(nodes):
        if n in seen:
            continue
        start = (n, 1)
        cur, back = (n, -1), [(n, -1)]
        while (m := nxt(*cur)) and m[0] != n:
            cur = m
            back.append(m)
        start = (back[-1][0], -back[-1][1]) if not (m and m[0] == n) else (n, 1)
        chain, cur = [start], start
        while (m := nxt(*cur)) and m[0] != start[0]:
            cur = m
            chain.append(m)
        seen.update(c for c, _ in chain)
        read = [c if d == 1 else rc(c) for c, d in chain]
        out.append(read[0] + "".join(r[-1] for r in read[1:]))
    return out


def genomes():
    random.seed(1)
    base = "".join(random.choices("ACGT", k=300))
    out = []
    for g in range(4):
        s = list(base)
        for _ in range(3):
            s[random.randrange(300)] = random.choice("ACGT")
        s = "".join(s)
        out.append((g, 0, s if g % 2 else rc(s)))
    out.append((4, 0, base[:100] + "NNNN" + base[150:] + base[:60]))
    ring = "".join(random.choices("ACGT", k=40))
    return out + [(5, 0, ring + ring[:10]), (5, 1, "ACG")]


def test_unitigs_and_paths(spark):
    k, rows = 11, genomes()
    contigs = spark.createDataFrame(rows, "genome_id int, contig_id int, seq string")
    placed = dbg.placed_kmers(dbg.pieces(contigs), k).cache()
    members = dbg.unitigs(placed).cache()
    nodes = dbg.unitig_table(members, k).cache()
    seqs = [p for _, _, s in rows for p in s.split("N") if p]
    want = plain_unitigs(seqs, k)
    got = [r.seq for r in nodes.collect()]
    canon = lambda s: min(s, rc(s))
    kmers_of = lambda s: frozenset(canon(s[i : i + k]) for i in range(len(s) - k + 1))
    assert Counter(map(kmers_of, got)) == Counter(map(kmers_of, want))
    assert sorted(r.node_id for r in nodes.collect()) == list(range(1, len(got) + 1))
    # paths spell the contigs they came from
    seq = {r.node_id: r.seq for r in nodes.collect()}
    paths = defaultdict(list)
    for r in dbg.genome_paths(placed, members, nodes).orderBy("genome_id", "contig_id", "piece", "pos").collect():
        paths[r.genome_id, r.contig_id, r.piece].append(r.node_id)
    for g, c, s in rows:
        for i, piece in enumerate(p for p in s.split("N") if p):
            if len(piece) >= k:
                text = ""
                for n in paths[g, c, i]:
                    x = seq[n] if n > 0 else rc(seq[-n])
                    text = text + x[k - 1 :] if text else x
                assert piece in text


def test_orfs_lifted_to_nodes_spell_their_sequence(spark):
    """Rebuilding an ORF from its nodes gives the contig's slice."""
    from pyspark.sql import functions as F

    from strandloom.operators.orf import orf_pairs
    from strandloom.operators.paths import path_sequence

    k = 11
    contigs = spark.createDataFrame(genomes(), "genome_id int, contig_id int, seq string")
    cut = dbg.pieces(contigs).withColumn("key", F.concat_ws(":", "genome_id", "contig_id", "piece")).cache()
    placed = dbg.placed_kmers(cut, k).cache()
    members = dbg.unitigs(placed).cache()
    nodes = dbg.unitig_table(members, k).cache()
    found = orf_pairs(cut, "key", "seq", 30).join(cut, F.col("id") == F.col("key")).select("genome_id", "contig_id", "piece", "start", (F.col("stop") + 3).alias("end"), "seq")
    lifted = dbg.lift(found, dbg.genome_paths(placed, members, nodes))
    keys = ["genome_id", "contig_id", "piece", "start", "end"]
    got = {tuple(r[c] for c in keys): r.seq for r in path_sequence(lifted, nodes, keys, k - 1).collect()}
    want = {tuple(r[c] for c in keys): r.seq[r.start : r.end] for r in found.collect()}
    assert want and got == want
