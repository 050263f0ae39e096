"""The unitig index by definition, and walks through the graph against a depth-first search for each genome."""

import random
from collections import defaultdict

import pytest

from strandloom.operators import dbg
from strandloom.operators import traversal as tr
from strandloom.session import written

STOPS = ("TAA", "TGA", "TAG")


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def frames(seq, least=0):
    return {(i - least) % 3 for i in range(least, len(seq) - 2) if seq[i : i + 3] in STOPS}


def mask(frames):
    return sum(1 << f for f in frames)


def graph(spark, contigs, k):
    df = spark.createDataFrame(contigs, "genome_id long, contig_id long, seq string")
    placed = written(dbg.placed_kmers(dbg.pieces(df), k), "placed")
    members = written(dbg.unitigs(placed), "members")
    nodes = written(dbg.unitig_table(members, k), "nodes")
    paths = written(dbg.genome_paths(placed, members, nodes), "paths")
    n = max(g for g, *_ in contigs) + 1
    index = written(tr.unitig_index(nodes, members, placed, paths, k, n), "index")
    return nodes, paths, index, n


def plain_graph(nodes, paths, contigs, k):
    """seq, colours, ends and steps of signed nodes, from what the unitigs spell and where contigs pass them."""
    seq = {}
    for r in nodes.collect():
        seq[r.node_id], seq[-r.node_id] = r.seq, rc(r.seq)
    has = defaultdict(set)
    for g, _, s in contigs:
        for p in s.split("N"):
            for i in range(len(p) - k + 1):
                has[min(p[i : i + k], rc(p[i : i + k]))].add(g)
    tip = lambda x: has[min(x, rc(x))]
    colours = {v: tip(s[:k]) | tip(s[-k:]) for v, s in seq.items()}
    walks = defaultdict(list)
    for r in paths.orderBy("pos").collect():
        walks[r.genome_id, r.contig_id, r.piece].append(r.node_id)
    ends, steps, of = defaultdict(set), defaultdict(set), defaultdict(set)
    for (g, *_), walk in walks.items():
        for v in (walk[0], walk[-1]):
            ends[v].add(g)
            ends[-v].add(g)
        for a, b in zip(walk, walk[1:]):
            for u, v in ((a, b), (-b, -a)):
                steps[u].add(v)
                of[u, v].add(g)
    return seq, colours, ends, steps, of


def depth_first(g, seq, colours, ends, steps, may, k, longest, repeat, refs):
    """The walks of one genome, as a search with a stack."""
    out = set()
    known = lambda v: refs is None or colours[v] & refs
    for head in seq:
        if g not in colours[head] and g not in ends[head] or not known(head):
            continue
        first = {0, 1, 2} if g in ends[head] else frames(seq[head])
        stack = [((head,), first, len(seq[head]))] if first else []
        while stack:
            path, left, size = stack.pop()
            for v in steps[path[-1]]:
                if not may(g, path[-1], v) or not repeat and v in path:
                    continue
                now = size + len(seq[v]) - (k - 1)
                if now > longest:
                    if len(path) == 1 and known(v):
                        out.add((g, (*path, v)))
                    continue
                new = {(f + size - 2) % 3 for f in frames(seq[v], k - 3)}
                rest = left - new
                if g in ends[v] or not rest:
                    if not known(v):
                        continue
                    out.add((g, (*path, v)))
                if rest:
                    stack.append(((*path, v), rest, now))
    return out


def made(seed, n=4, size=70, letters="ACGT"):
    r = random.Random(seed)
    base = "".join(r.choices(letters, k=size))
    out = []
    for g in range(n):
        s = list(base)
        for _ in range(3):
            s[r.randrange(size)] = r.choice(letters)
        s = "".join(s)
        s = s[r.randrange(8) :] + s[10:25] * (g % 2)  # a repeat closes a cycle
        out.append((g, 0, s if g % 2 else rc(s)))
    return [*out, (n - 1, 1, base[5:40] + "N" + base[30:60])]


CASES = [(1, 7, "ACGT", 50), (3, 7, "ATG", 30)]


@pytest.mark.parametrize("seed,k,letters,longest", CASES)
def test_walks_against_depth_first(spark, seed, k, letters, longest):
    contigs = made(seed, letters=letters)
    nodes, paths, index, n = graph(spark, contigs, k)
    seq, colours, ends, steps, of = plain_graph(nodes, paths, contigs, k)
    got = {r.node: r for r in index.collect()}
    assert set(got) == set(seq)
    for v, s in seq.items():
        r = got[v]
        word = lambda gs: [sum(1 << g for g in gs)]
        assert (r.size, r.n_stops, r.stops, r.entering) == (len(s), sum(s[i : i + 3] in STOPS for i in range(len(s) - 2)), mask(frames(s)), mask(frames(s, k - 3)))
        assert list(r.colours) == word(colours[v]) and list(r.ends) == word(ends[v])
    every = [s for s in seq.values()]
    assert tr.stop_frequency(index) == pytest.approx(sum(s[i : i + 3] in STOPS for s in every for i in range(len(s) - 2)) / sum(len(s) - 2 for s in every))
    for of_contigs, repeat, refs in ((True, False, None), (False, False, {0, 2}), (True, True, None)):
        may = (lambda g, u, v: g in of[u, v]) if of_contigs else (lambda g, u, v: g in colours[v])
        want = set().union(*(depth_first(g, seq, colours, ends, steps, may, k, longest, repeat, refs) for g in range(n)))
        links = tr.graph_steps(index, paths, n, of_contigs)
        rows = tr.stop_paths(index, links, k, longest, repeat, None if refs is None else [sum(1 << g for g in refs)]).select("path", tr.bits(tr.F.col("genomes")).alias("g")).collect()
        found = [(g, tuple(r.path)) for r in rows for g in r.g]
        assert len(found) == len(set(found)) and set(found) == want and (want or refs)


def test_more_genomes_than_a_word_holds(spark):
    contigs = [(g, 0, s) for g in range(130) for s in [made(9, 2, 40)[g % 2][2]]]
    nodes, paths, index, n = graph(spark, contigs, 9)
    r = index.first()
    assert len(r.colours) == tr.width(n) == 3
    sizes = index.select(tr.bits(tr.F.col("colours")).alias("g")).collect()
    assert {len(r.g) for r in sizes} <= {65, 130} and all(set(r.g) in ({*range(0, 130, 2)}, {*range(1, 130, 2)}, {*range(130)}) for r in sizes)


def test_empty_graph(spark):
    nodes, paths, index, _ = graph(spark, [(0, 0, "ACG")], 7)
    assert index.count() == 0 and tr.stop_frequency(index) == 0 and tr.stop_paths(index, tr.graph_steps(index, paths, 1, True), 7).count() == 0
