"""How ORFs overlap as paths of oriented nodes, without coordinates of a contig.

Two paths overlap if one reads the other's nodes on a stretch that reaches an end of either at both of its sides:
contained, suffix on prefix, or prefix on suffix. Such a stretch holds an end node of one of them, so only end nodes
are looked up in the index of all nodes: a node inside many paths makes no pairs unless paths begin or end there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.overlap import overlap_type
from strandloom.session import written

def sized(orfs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``orfs`` with ``coords`` (node, s, e) as ``path`` (node, s, e, size), in order. nodes (node_id, size)."""
    each = orfs.select(*keys, F.posexplode("coords").alias("at", "c")).join(nodes.select(F.col("node_id").alias("_id"), F.col("size").cast("int").alias("size")), F.abs(F.col("c.node")) == F.col("_id"))
    paths = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.struct("c.node", "c.s", "c.e", "size").alias("p")))).alias("x"))
    return orfs.drop("coords").join(paths.select(*keys, F.transform("x", lambda v: v["p"]).alias("path")), keys)


def trimmed(path: Column, k: int) -> Column:
    """A path without the end nodes of which it has only bases that the node beside them has too; a path that has
    nothing but such bases stays as it is."""
    inner = F.sequence(F.lit(0), F.size(path) - 1)
    first = F.array_min(F.filter(inner, lambda i: F.get(path, i)["s"] < F.get(path, i)["size"] - (k - 1)))
    last = F.array_max(F.filter(inner, lambda i: F.get(path, i)["e"] > k - 1))
    return F.when(first <= last, F.slice(path, first + 1, last - first + 1)).otherwise(path)


def turned(path: Column) -> Column:
    """A path read the other way."""
    return F.reverse(F.transform(path, lambda c: F.struct((-c["node"]).alias("node"), (c["size"] - c["e"]).alias("s"), (c["size"] - c["s"]).alias("e"), c["size"].alias("size"))))


def path_overlaps(orfs: DataFrame, k: int, max_overlap: int = 60) -> DataFrame:
    """(key, src, dst, type, bp) from orfs (key, orf, strand as 1 or -1, path), as of ``overlap.classify``.

    src is the one that begins first on the strand that ``strand`` is of, and the containing one of an overlap within.
    Of several ways in which two paths overlap the one with most bases counts, ties for the same direction. An ORF comes
    once a key; paths are at least a node long.
    """
    # with and without end nodes that add no bases: paths may part just there
    cut = written(orfs.select("key", "orf", "strand", F.explode(F.array_distinct(F.array("path", trimmed(F.col("path"), k)))).alias("path")), "node-paths")
    ways = cut.select("key", F.col("orf").alias("x"), F.lit(1).alias("d"), F.col("path").alias("xc")).unionByName(cut.select("key", F.col("orf").alias("x"), F.lit(-1).alias("d"), turned(F.col("path")).alias("xc")))
    # an end node of x, and at which of its positions: the first in both directions, the last of the turned path too
    tips = F.when(F.col("d") == 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.array(F.lit(0), F.size("xc") - 1)))
    asks = ways.withColumn("t", F.explode(tips)).withColumn("node", F.get("xc", F.col("t"))["node"])
    index = cut.select("key", F.col("orf").alias("y"), "strand", F.col("path").alias("yc"), F.posexplode(F.transform("path", lambda c: c["node"])).alias("at", "node"))
    met = asks.join(index, ["key", "node"]).where("x <> y")
    nx, ny = F.size("xc"), F.size("yc")
    # from the end node on while both go on, to either side
    q = F.col("t") - F.least("t", "at")
    p = F.col("at") - F.least("t", "at")
    run = F.least(nx - q, ny - p)
    nodes = lambda c, a, n: F.transform(F.slice(c, a + 1, n), lambda v: v["node"])
    same = met.withColumns({"q": q, "p": p, "n": run}).where(nodes("xc", F.col("q"), F.col("n")) == nodes("yc", F.col("p"), F.col("n")))
    # from where to where each path reaches, counted from the first base of the first node they share
    until = lambda c, i: F.aggregate(F.slice(c, F.lit(1), i), F.lit(0).cast("long"), lambda a, v: a + v["size"] - (k - 1))
    begin = lambda c, i: F.get(c, F.lit(0))["s"] - until(c, i)
    end = lambda c, i: until(c, F.size(c) - 1) + F.get(c, F.size(c) - 1)["e"] - until(c, i)
    placed = same.select("key", "x", "y", "d", "strand", begin("xc", F.col("q")).alias("a1"), end("xc", F.col("q")).alias("b1"), begin("yc", F.col("p")).alias("a2"), end("yc", F.col("p")).alias("b2"))
    flip = F.col("strand") < 0
    placed = placed.select("key", "x", "y", "d", "strand", *[F.when(flip, -F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("a1", "b1"), ("a2", "b2"))], *[F.when(flip, -F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("a1", "b1"), ("a2", "b2"))])
    lo, hi = F.greatest("a1", "a2"), F.least("b1", "b2")

    def inside(a: str, b: str, direction: Column) -> Column:
        left, right = F.col(a) >= lo, F.col(b) <= hi
        return F.when(left & right, 53).when(left, F.when(direction > 0, 5).otherwise(3)).when(right, F.when(direction > 0, 3).otherwise(5)).otherwise(0)

    bp = hi - lo
    kind = overlap_type(inside("a1", "b1", F.col("d") * F.col("strand")), inside("a2", "b2", F.col("strand")), bp, max_overlap)
    y_first = (F.col("a2") < F.col("a1")) | ((F.col("a2") == F.col("a1")) & ((F.col("b2") > F.col("b1")) | ((F.col("b2") == F.col("b1")) & (F.col("y") < F.col("x")))))
    each = placed.where(bp > 0).select("key", F.when(y_first, F.col("y")).otherwise(F.col("x")).alias("src"), F.when(y_first, F.col("x")).otherwise(F.col("y")).alias("dst"), kind.alias("type"), bp.alias("bp"), "d").where("type IS NOT NULL")
    best = each.groupBy("key", F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).agg(F.min(F.struct((-F.col("bp")).alias("b"), (-F.col("d")).alias("d"), "src", "dst", "type", "bp")).alias("o"))
    return best.select("key", "o.src", "o.dst", "o.type", "o.bp")
