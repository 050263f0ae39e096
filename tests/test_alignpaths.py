"""Overlaps of node paths: as on the contig where nothing repeats, and against all placements where much does."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import alignpaths, dbg, overlap
from strandloom.session import written


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def lifted(spark, contigs, k, spans):
    """spans (contig, start, end, strand, orf) as paths; one read on strand -1 has its path turned."""
    df = spark.createDataFrame([(0, c, s) for c, s in enumerate(contigs)], "genome_id long, contig_id long, seq string")
    placed = written(dbg.placed_kmers(dbg.pieces(df), k), "placed")
    members = written(dbg.unitigs(placed), "members")
    nodes = written(dbg.unitig_table(members, k), "nodes")
    paths = written(dbg.genome_paths(placed, members, nodes), "paths")
    orfs = spark.createDataFrame(spans, "contig_id long, start long, end long, strand int, orf long").withColumn("genome_id", F.lit(0).cast("long")).withColumn("piece", F.lit(0))
    on = dbg.lift(orfs, paths).join(orfs.select("contig_id", "start", "end", "strand", "orf"), ["contig_id", "start", "end"])
    done = alignpaths.sized(on.select(F.lit(0).alias("key"), "orf", "strand", "coords"), nodes, ["key", "orf"])
    flip = F.col("strand") < 0
    return nodes, written(done.select("key", "orf", "strand", F.when(flip, alignpaths.turned(F.col("path"))).otherwise(F.col("path")).alias("path")), "orfs")


def rows_of(df):
    got = [(r.src, r.dst, r.type, r.bp) for r in df.collect()]
    assert len(got) == len({frozenset(g[:2]) for g in got})
    return set(got)


def test_as_on_the_contig(spark):
    r = random.Random(3)
    base = "".join(r.choices("ACGT", k=700))
    other = "".join(r.choices("ACGT", k=700))
    mutated = list(base)
    for i in range(20, 700, 45):  # bubbles: the contig is cut into many nodes
        mutated[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[mutated[i]]
    spans = []
    for i in range(60):
        a = r.randrange(0, 640)
        spans.append((0, a, min(a + r.randrange(20, 160), 700), r.choice((1, -1)), 1000 - i))
    spans = list({s[:3]: s for s in spans}.values())
    _, orfs = lifted(spark, [base, "".join(mutated), other], 13, spans)
    want = overlap.classify(spark.createDataFrame([(0, o, a, b, d) for _, a, b, d, o in spans], "key int, orf long, start long, end long, strand int"))
    got = rows_of(alignpaths.path_overlaps(orfs, 13))
    assert got == rows_of(want) and {t for *_, t, _ in got} == {"u", "c", "d", "w", "i"}


def plain(orfs, k):
    """Every placement of one path on another in both directions, checked base by base."""
    out = {}
    for y in orfs:
        for x in orfs:
            if x["orf"] == y["orf"]:
                continue
            for d in (1, -1):
                xc = [(c["node"], c["s"], c["e"], c["size"]) for c in x["path"]]
                if d < 0:
                    xc = [(-v, z - e, z - s, z) for v, s, e, z in reversed(xc)]
                yc = [(c["node"], c["s"], c["e"], c["size"]) for c in y["path"]]
                ways = [(a, b) for a in (xc, strip(xc, k)) for b in (yc, strip(yc, k))]
                for xc, yc, shift in [(a, b, s) for a, b in ways for s in range(-len(a) + 1, len(b))]:
                    pairs = [(i, i + shift) for i in range(len(xc)) if 0 <= i + shift < len(yc)]
                    if not all(xc[i][0] == yc[j][0] for i, j in pairs):
                        continue
                    offset, have = 0, []
                    for i, j in pairs:
                        have.append(({offset + b for b in range(xc[i][1], xc[i][2])}, {offset + b for b in range(yc[j][1], yc[j][2])}))
                        offset += yc[j][3] - (k - 1)
                    bp = len(set().union(*(a for a, _ in have)) & set().union(*(b for _, b in have)))
                    if bp:
                        pair = frozenset((x["orf"], y["orf"]))
                        out[pair] = max(out.get(pair, (0, 0)), (bp, d))
    return {p: bp for p, (bp, _) in out.items()}


def strip(c, k):
    keep = c[:]
    while len(keep) > 1 and keep[0][1] >= keep[0][3] - (k - 1):
        keep = keep[1:]
    while len(keep) > 1 and keep[-1][2] <= k - 1:
        keep = keep[:-1]
    return keep


@pytest.mark.parametrize("seed,letters", [(1, "ACGT"), (2, "AT")])
def test_against_all_placements_on_graphs_with_repeats(spark, seed, letters):
    r, k = random.Random(seed), 7
    base = "".join(r.choices(letters, k=120))
    contigs = [base + base[20:50] + rc(base[60:90]), base[:60] + "".join(r.choices(letters, k=30)) + base[60:]]
    spans = [(c, a, a + r.randrange(8, 40), r.choice((1, -1)), 100 * c + i) for c in (0, 1) for i, a in enumerate(r.sample(range(0, 110), 14))]
    _, orfs = lifted(spark, contigs, k, spans)
    got = {frozenset(g[:2]): g[3] for g in rows_of(alignpaths.path_overlaps(orfs, k, 10**6))}
    want = plain([x.asDict(True) for x in orfs.collect()], k)
    assert got == want and len(want) > 30


def test_nothing_to_align(spark):
    none = spark.createDataFrame([], "key int, orf long, strand int, path array<struct<node: long, s: int, e: int, size: int>>")
    one = spark.createDataFrame([(0, 1, 1, [(5, 0, 9, 9)])], none.schema)
    assert alignpaths.path_overlaps(none, 7).count() == 0 and alignpaths.path_overlaps(one, 7).count() == 0
