"""Walks beyond genes and their next genes, against searches with a stack."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import alignpaths, dbg, outward
from strandloom.operators import traversal as tr
from strandloom.session import written
from tests.test_traversal import graph, made, plain_graph


def laid(spark, contigs, nodes, paths, seed):
    """(genome_id, gene, path): genes on stretches of the contigs, some of them close together."""
    r, rows = random.Random(seed), []
    for g, c, s in contigs:
        for piece, p in enumerate(s.split("N")):
            at = 0
            while at + 12 < len(p):
                a, b = at + r.randrange(6), at + 6 + r.randrange(14)
                if a < b <= len(p):
                    rows.append((g, c, piece, a, b))
                at += 16
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "genome_id long, contig_id long, piece int, start int, end int, gene long")
    keys = ["genome_id", "contig_id", "piece", "start", "end"]
    lifted = dbg.lift(df, paths).join(df, keys)
    return written(alignpaths.sized(lifted, nodes, ["genome_id", "gene"]).select("genome_id", "gene", "path"), "genes")


def heads_of(genes):
    for g, i, path in genes:
        a, b = path[0], path[-1]
        yield g, i, 1, b.node, b.s, b.e, b.size
        yield g, i, -1, -a.node, a.size - a.e, a.size - a.s, a.size


def plain_walks(genes, seq, ends, steps, may, k, radius, repeat, known):
    full = {(g, abs(c.node)) for g, _, path in genes for c in path if c.s == 0 and c.e == c.size}
    out = []
    for g, i, side, node, _, far, size in heads_of(genes):
        if size - far >= radius:
            out.append((g, i, side, (node,), size - far, "radius"))
            continue
        stack = [((node,), size - far, False, False)]
        while stack:
            path, n, after, told = stack.pop()
            can = [v for v in steps[path[-1]] if may(g, path[-1], v) and known(v) and (repeat or v not in path)]
            on = [v for v in can if not (after and (g, abs(v)) in full)]
            if not on:
                if not told:
                    out.append((g, i, side, path, n, "blocked" if can else "dead"))
                continue
            for v in on:
                m = n + len(seq[v]) - (k - 1)
                if m >= radius:
                    out.append((g, i, side, (*path, v), m, "radius"))
                    continue
                if g in ends[v]:
                    out.append((g, i, side, (*path, v), m, "end"))
                stack.append(((*path, v), m, (g, abs(v)) in full, g in ends[v]))
    return out


def plain_next(genes, seq, steps, may, k, most, repeat, known):
    lie = {}
    for g, i, _, node, near, far, size in heads_of(genes):
        lie.setdefault((g, node), set()).add((near, far, i))
        lie.setdefault((g, -node), set()).add((size - far, size - near, i))
    out = {}
    keep = lambda g, i, side, j, gap: gap <= most and out.__setitem__((g, i, side, j), min(gap, out.get((g, i, side, j), gap)))
    for g, i, side, node, near, far, size in heads_of(genes):
        later = sorted(x for x in lie[g, node] if x > (near, far, i) and x[2] != i)
        if later:
            keep(g, i, side, later[0][2], later[0][0] - far)
            continue
        stack = [((node,), size - far)]
        while stack:
            path, n = stack.pop()
            if n - (k - 1) > most:
                continue
            for v in steps[path[-1]]:
                if not may(g, path[-1], v) or not known(v) or not repeat and v in path:
                    continue
                there = lie.get((g, v))
                if not there:
                    stack.append(((*path, v), n + len(seq[v]) - (k - 1)))
                    continue
                others = sorted(x for x in there if x[2] != i)
                if others:
                    keep(g, i, side, others[0][2], n - (k - 1) + others[0][0])
    return out


@pytest.mark.parametrize("seed,k,of_contigs,repeat,least,radius", [(1, 7, True, False, 1, 25), (3, 5, False, False, 2, 14), (5, 6, True, True, 1, 18)])
def test_against_a_stack(spark, seed, k, of_contigs, repeat, least, radius):
    contigs = made(seed)
    nodes, paths, index, n = graph(spark, contigs, k)
    seq, colours, ends, steps, of = plain_graph(nodes, paths, contigs, k)
    genes = laid(spark, contigs, nodes, paths, seed)
    plain = [(r.genome_id, r.gene, r.path) for r in genes.collect()]
    may = (lambda g, u, v: g in of[u, v]) if of_contigs else (lambda g, u, v: g in colours[v])
    known = lambda v: len(colours[v]) >= least
    links = written(tr.graph_steps(index, paths, n, of_contigs), "steps")

    walks = written(outward.extend(genes, links, k, n, radius, None, repeat, least), "walks")
    got = sorted((r.genome_id, r.gene, r.side, tuple(r.path), r.length, r.why) for r in walks.collect())
    want = sorted(plain_walks(plain, seq, ends, steps, may, k, radius, repeat, known))
    assert got == want and {"radius", "blocked"} <= {w[5] for w in want}

    best = {}
    for g, i, side, path, m, why in want:
        if why != "blocked" and ((g, i, side) not in best or (-m, path) < best[g, i, side]):
            best[g, i, side] = (-m, path)
    far = written(outward.farthest(walks), "farthest")
    assert {(r.genome_id, r.gene, r.side): (-r.length, tuple(r.path)) for r in far.collect()} == best
    assert outward.farthest(walks, True).count() == 2 * len(plain)

    read = spark.createDataFrame(list(seq.items()), "node long, seq string")
    for r in outward.around(genes, far, read, k).collect():
        own = [c.node for c in next(p for g, i, p in plain if (g, i) == (r.genome_id, r.gene))]
        up, down = (best.get((r.genome_id, r.gene, s), (0, (0,)))[1][1:] for s in (-1, 1))
        path = [*(-v for v in reversed(up)), *own, *down]
        assert list(r.path) == path and r.seq == seq[path[0]] + "".join(seq[v][k - 1 :] for v in path[1:])

    nexts = outward.next_genes(genes, links, k, n, radius, repeat, least)
    rows = nexts.collect()
    want = plain_next(plain, seq, steps, may, k, radius, repeat, known)
    assert {(r.genome_id, r.gene, r.side, r.other): r.gap for r in rows} == want and len(rows) == len(want) > 10
    pairs = {}
    for (g, i, _, j), gap in want.items():
        key = (g, min(i, j), max(i, j))
        pairs[key] = min(gap, pairs.get(key, gap))
    assert {(r.genome_id, r.a, r.b): r.gap for r in outward.connections(nexts).collect()} == pairs


def test_genes_of_a_line_meet_in_order(spark):
    s = "".join(random.Random(11).choices("ACGT", k=120))
    nodes, paths, index, n = graph(spark, [(0, 0, s), (1, 0, s[:60])], 9)
    df = spark.createDataFrame([(0, 0, 0, a, a + 20, i) for i, a in enumerate((5, 30, 45, 90))], "genome_id long, contig_id long, piece int, start int, end int, gene long")
    genes = alignpaths.sized(dbg.lift(df, paths).join(df, ["genome_id", "contig_id", "piece", "start", "end"]), nodes, ["genome_id", "gene"]).select("genome_id", "gene", "path")
    links = tr.graph_steps(index, paths, n, True)
    got = {(r.a, r.b): r.gap for r in outward.connections(outward.next_genes(genes, links, 9, n, 100)).collect()}
    assert got == {(0, 1): 5, (1, 2): -5, (2, 3): 25}
    only = outward.next_genes(genes, links, 9, n, 100, of=genes.where("gene = 3")).collect()
    assert [(r.gene, r.side, r.other, r.gap) for r in only] == [(3, -1, 2, 25)]
    assert outward.next_genes(genes, links, 9, n, 20).where(F.greatest("gene", "other") == 3).count() == 0


def test_nothing_to_search(spark):
    nodes, paths, index, n = graph(spark, [(0, 0, "ACGTTGCAACTG")], 7)
    genes = spark.createDataFrame([(0, 1, [])], "genome_id long, gene long, path array<struct<node:long,s:int,e:int,size:int>>")
    links = tr.graph_steps(index, paths, n, True)
    for g in (genes, genes.limit(0)):
        walks = outward.extend(g, links, 7, n, 10)
        assert walks.count() == 0 and outward.farthest(walks).count() == 0
        assert outward.next_genes(g, links, 7, n, 10).count() == 0
