"""Best chains of overlap graphs against all chains of their transitive closure; cycles; components."""

import random
from collections import defaultdict

import pytest

from strandloom.operators import overlapgraph as og
from strandloom.operators.bestpath import PENALTY


def plain(score, edges):
    """{node of a component: its best total}, trying every ancestor of every node in topological order."""
    after, before = defaultdict(set), defaultdict(dict)
    for a, b, kind, bp in edges:
        after[a].add(b)
        before[b][a] = (kind, bp)
    order, seen = [], set()

    def visit(v):
        if v not in seen:
            seen.add(v)
            for w in after[v]:
                visit(w)
            order.append(v)

    for v in score:
        visit(v)
    above, best = defaultdict(set), {}
    for v in reversed(order):
        for a in before[v]:
            above[v] |= above[a] | {a}
        options = [0.0]
        for a in above[v]:
            kind, bp = before[v].get(a, (None, 0))
            if kind != "i":
                options.append(best[a] - (PENALTY[kind] * bp if kind else 0))
        best[v] = score[v] + max(options)
    parent = {v: v for v in score}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b, *_ in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    total = defaultdict(lambda: float("-inf"))
    for v in score:
        total[find(v)] = max(total[find(v)], best[v])
    return {v: total[find(v)] for v in score}


def value(chain, score, edges):
    """What a chain is worth, in the order of its nodes; None if two that follow each other cannot."""
    kinds = {(a, b): (k, n) for a, b, k, n in edges}
    total = score[chain[0]]
    for a, b in zip(chain, chain[1:]):
        kind, bp = kinds.get((a, b), ("w", 0))
        if kind == "i":
            return None
        total += score[b] - PENALTY[kind] * bp
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_ancestors(spark, seed):
    r = random.Random(seed)
    orfs, overlaps, want = [], [], {}
    for key in range(4):
        n = 14
        score = {v: float(r.randint(-40, 120)) for v in range(n)}
        rank = list(range(n))
        r.shuffle(rank)  # the order along the genome is not that of the ids
        edges = [(rank[i], rank[j], r.choice("ucdwi"), r.randint(1, 15)) for i in range(n) for j in range(i + 1, min(i + 4, n)) if r.random() < 0.45]
        orfs += [(key, v, s) for v, s in score.items()]
        overlaps += [(key, *e) for e in edges]
        want |= {(key, v): t for v, t in plain(score, edges).items()}
        if key == 0:
            first = (score, edges, rank)
    got = og.best_gene_paths(spark.createDataFrame(orfs, "key int, orf long, score double"), spark.createDataFrame(overlaps, "key int, src long, dst long, type string, bp long"), 60.0).collect()
    assert {(g.key, g.orf): round(g.total, 6) for g in got} == {k: round(want[k], 6) for k in {(g.key, g.orf) for g in got}}
    chains = defaultdict(list)
    for g in got:
        chains[g.key, round(g.total, 6)].append(g.orf)
    assert {(k, round(t, 6)) for (k, _), t in want.items() if t >= 60} == set(chains)
    score, edges, rank = first
    for (key, total), chain in chains.items():
        if key == 0 and sum(round(t, 6) == total for t in {t for (k, _), t in want.items() if k == 0}) == 1:
            assert value(sorted(chain, key=rank.index), score, edges) == pytest.approx(total)


def test_cycles_are_cut(spark):
    ring = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (9, 8), (8, 7), (6, 1)]
    left = {(r.a, r.b) for r in og.cut_cycles(spark.createDataFrame(ring, "a long, b long")).collect()}
    assert left == set(ring) - {(3, 1), (5, 4)}
    orfs = spark.createDataFrame([(0, v, 50.0) for v in range(1, 10)], "key int, orf long, score double")
    overlaps = spark.createDataFrame([(0, a, b, "w", 1) for a, b in ring], "key int, src long, dst long, type string, bp long")
    assert {r.orf for r in og.best_gene_paths(orfs, overlaps).collect()} >= {7, 8, 9}


def test_edges_of_the_input(spark):
    orfs = spark.createDataFrame([(0, 1, 150.0), (0, 2, None), (1, 1, 99.0)], "key int, orf long, score double")
    none = spark.createDataFrame([], "key int, src long, dst long, type string, bp long")
    odd = spark.createDataFrame([(0, 1, 1, "u", 5), (0, 1, 77, "u", 5), (0, 1, 2, "i", 9), (0, 1, 2, "u", 9)], none.schema)
    assert [(r.key, r.orf, r.total) for r in og.best_gene_paths(orfs, none).collect()] == [(0, 1, 150.0)]
    assert [(r.key, r.orf, r.total) for r in og.best_gene_paths(orfs, odd).collect()] == [(0, 1, 150.0)]
    assert og.best_gene_paths(orfs.limit(0), none).count() == 0
