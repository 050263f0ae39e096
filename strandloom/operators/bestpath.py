"""The best-scoring set of genes along a genome, given scores and overlaps."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandloom.operators import filters

# Penalty per overlapping base of each kind of overlap; w costs nothing, i excludes.
PENALTY = {"u": 3.895921717182765, "c": 4.603432608883688, "d": 3.3830814940689975, "w": 0.0}


def heaviest(ids: list, start: list, end: list, score: list, rule: dict[tuple, tuple[str, int]]) -> tuple[list, float]:
    """The chain of ORFs by start with the largest sum of scores less penalties.

    rule maps (earlier, later) to (type, bp). A pair without a rule does not overlap and costs nothing. The best
    chain ending at an ORF extends the best one that ended before, or one that ends in an ORF overlapping it. One sweep
    over the starts: the chains that have ended are kept as the best so far, the open ones are met through their rules.
    """
    order = sorted(range(len(ids)), key=lambda k: (start[k], end[k], ids[k]))
    rank, place = {k: n for n, k in enumerate(order)}, {i: k for k, i in enumerate(ids)}
    ruled: dict[int, list[tuple[int, str, int]]] = {}
    for (a, b), (kind, bp) in rule.items():
        if a in place and b in place and kind != "i":
            ruled.setdefault(place[b], []).append((place[a], kind, bp))
    best, back = [0.0] * len(ids), [None] * len(ids)
    ending, top, last = [], -math.inf, None  # open chains by end; the best of those that ended
    for k in order:
        while ending and ending[0][0] <= start[k]:
            _, _, j = heapq.heappop(ending)
            if (best[j], -rank[j]) > (top, -rank[last] if last is not None else 0):
                top, last = best[j], j
        value, prior = score[k], None
        options = [(best[j] + score[k] - PENALTY[kind] * bp, j) for j, kind, bp in ruled.get(k, ()) if rank[j] < rank[k]]
        if last is not None:
            options.append((top + score[k], last))
        for v, j in sorted(options, key=lambda x: rank[x[1]]):
            if v > value:
                value, prior = v, j
        best[k], back[k] = value, prior
        heapq.heappush(ending, (end[k], rank[k], k))
    if not order:
        return [], 0.0
    k = max(order, key=lambda x: (best[x], -x))
    total, path = best[k], []
    while k is not None:
        path.append(ids[k])
        k = back[k]
    return path[::-1], total


def best_paths(orfs: DataFrame, overlaps: DataFrame, min_score: float = 100.0) -> DataFrame:
    """(key, orf): the ORFs kept. orfs (key, orf: long, start, end, score), overlaps (key, src, dst, type, bp).

    A key is cut wherever an ORF begins after all before it have ended: nothing overlaps across a cut, so the stretches
    are solved each on its own, and an ORF that is a stretch of its own is kept on its score. Stretches lie one after
    another in Arrow batches, as most are short; a task holds a batch and the longest stretch of ORFs that overlap each
    other without a gap.
    """
    by = Window.partitionBy("key").orderBy("start", "end", "orf")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = orfs.select("key", "orf", "start", "end", "score").withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    placed = cut.withColumn("_part", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("_n", F.count("*").over(Window.partitionBy("key", "_part")))
    alone = placed.where("_n = 1").where(filters.good_score(F.col("score"), min_score)).select("key", "orf")
    listed = overlaps.select("key", F.col("src").alias("orf"), F.struct("dst", "type", "bp").alias("o")).groupBy("key", "orf").agg(F.collect_list("o").alias("o"))
    tangled = placed.where("_n > 1").join(listed, ["key", "orf"], "left")
    together = tangled.repartition("key", "_part").sortWithinPartitions("key", "_part", "start", "end", "orf").select("key", "orf", "start", "end", "score", "_new", "o")

    def solve(rows: list[dict]) -> list[bool]:
        rule = {(r["orf"], o["dst"]): (o["type"], o["bp"]) for r in rows if r["o"] is not None for o in r["o"]}
        path, total = heaviest(*([r[c] for r in rows] for c in ("orf", "start", "end", "score")), rule)
        kept = set(path) if total >= min_score else set()
        return [r["orf"] in kept for r in rows]

    def scan(batches):
        held, rows = [], []  # the stretch that may go on in the next batch
        for batch in batches:
            held.append(batch.select(["key", "orf"]))
            keep = []
            for r in batch.drop_columns(["key"]).to_pylist():
                if r["_new"] and rows:
                    keep += solve(rows)
                    rows = []
                rows.append(r)
            if keep:
                yield from chosen(held, keep)
                held = pa.Table.from_batches(held).slice(len(keep)).to_batches()
        if rows:
            yield from chosen(held, solve(rows))

    def chosen(held, keep):
        return pa.Table.from_batches(held).slice(0, len(keep)).filter(pa.array(keep)).to_batches()

    kinds = {f.name: f.dataType for f in orfs.schema.fields}
    schema = StructType([StructField("key", kinds["key"]), StructField("orf", kinds["orf"])])
    return together.mapInArrow(scan, schema).unionByName(alone)
