"""ORFs that share nodes or bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import written


def shared_pairs(rows: DataFrame, item: str, node: str) -> DataFrame:
    """(a, b, n_shared), a < b: items that share nodes, from (item, node). Partial sums combine before the shuffle."""
    left = rows.select(F.col(node).alias("node"), F.col(item).alias("a")).distinct()
    right = left.select(F.col("node").alias("n2"), F.col("a").alias("b"))
    return left.join(right, (F.col("node") == F.col("n2")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def shared_counts(rows: DataFrame, item: str, node: str, most: int = 64) -> DataFrame:
    """(n_shared, n_pairs): how many pairs of items share how many nodes, as many as ``shared_pairs`` has, from (item, node).

    Pairs that share a single node are by far the most and never become rows: a node of n items has n * (n - 1) / 2 pairs, and
    these sum up to all pairs, counted once for each node they share. Pairs that share more are met at pairs of nodes: two
    items with n nodes in common share n * (n - 1) / 2 of them. Items of over ``most`` nodes have too many pairs of these and are
    paired with all others at their nodes instead.
    """
    each = rows.select(F.col(item).alias("item"), F.col(node).alias("node")).where("item IS NOT NULL AND node IS NOT NULL").distinct()
    each = written(each.withColumn("many", F.count("*").over(Window.partitionBy("item")) > most), "items")
    few, many = each.where("NOT many"), each.where("many")
    halves = lambda n: F.floor(F.col(n) * (F.col(n) - 1) / 2).cast("long")
    met = few.groupBy("node").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(halves("n")), F.lit(0)).cast("long").alias("met"))
    # the nodes of an item, each with those after it
    listed = few.groupBy("item").agg(F.sort_array(F.collect_list("node")).alias("of")).where(F.size("of") > 1)
    first = listed.select("item", "of", F.posexplode("of").alias("i", "x"))
    two = first.select("item", "x", F.explode(F.slice("of", F.col("i") + 2, F.size("of") - F.col("i") - 1)).alias("y"))
    # only pairs of nodes that several items have are paired
    common = two.groupBy("x", "y").agg(F.sort_array(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    left = common.select("items", F.posexplode("items").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items") - F.col("i") - 1)).alias("b"))
    more = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("n_pairs"))
    more = written(more.select(F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("n_shared"), "n_pairs"), "shared")
    rest = met.crossJoin(more.agg(F.coalesce(F.sum(F.col("n_shared") * F.col("n_pairs")), F.lit(0)).alias("sum")))  # a row
    single = rest.select(F.lit(1).cast("long").alias("n_shared"), (F.col("met") - F.col("sum")).alias("n_pairs")).where("n_pairs > 0")
    other = each.select(F.col("node").alias("n2"), F.col("item").alias("b"), F.col("many").alias("many2"))
    large = many.join(other, (F.col("node") == F.col("n2")) & (~F.col("many2") & (F.col("item") != F.col("b")) | (F.col("item") < F.col("b")))).groupBy("item", "b").agg(F.count("*").alias("n_shared"))
    found = single.unionByName(more).unionByName(large.groupBy("n_shared").agg(F.count("*").alias("n_pairs")))
    return found.groupBy("n_shared").agg(F.sum("n_pairs").alias("n_pairs"))


def interval_pairs(rows: DataFrame, key: str, id_col: str, start: str, end: str, bin_size: int = 1024) -> DataFrame:
    """(key, a, b, bp), a < b: overlapping intervals [start, end) of a key and by how many positions.

    A range join by bins: intervals meet in the bins they touch and are paired in the bin where the later one starts,
    so no pair comes twice and a long key is spread over its bins.
    """
    binned = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))).alias("bin"))
    other = binned.select(F.col("key").alias("k2"), F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("bin").alias("bin2"))
    met = binned.join(other, (F.col("key") == F.col("k2")) & (F.col("bin") == F.col("bin2")) & (F.col("id") < F.col("id2")))
    meet = met.where((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & (F.floor(F.greatest("s", "s2") / bin_size) == F.col("bin")))
    return meet.select("key", F.col("id").alias("a"), F.col("id2").alias("b"), (F.least("e", "e2") - F.greatest("s", "s2")).alias("bp"))


def overlap_type(first_ends: Column, second_ends: Column, bp: Column, max_overlap: int) -> Column:
    """Kind of an overlap from which ends lie inside it: u same direction, c 3' ends meet, d 5' ends meet, w within;
    i if it is longer than allowed, null if there is none.

    first_ends and second_ends are 5, 3, 53 (the ORF lies within) or 0: the ends of each ORF inside the overlap.
    """
    kind = (
        F.when((first_ends == 53) | (second_ends == 53), "w")
        .when((first_ends == 3) & (second_ends == 3), "c")
        .when((first_ends == 5) & (second_ends == 5), "d")
        .when(first_ends.isin(3, 5) & second_ends.isin(3, 5), "u")
    )
    return F.when(bp <= 0, None).when(bp > max_overlap, "i").otherwise(kind)


def classify(orfs: DataFrame, max_overlap: int = 60) -> DataFrame:
    """(key, src, dst, type, bp) from orfs (key, orf, start, end, strand as 1 or -1) on shared coordinates.

    src is the ORF that begins first, and the containing one of an overlap within.
    """
    pairs = interval_pairs(orfs, "key", "orf", "start", "end")
    one = orfs.select("key", F.col("orf").alias("a"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("strand").alias("d"))
    two = orfs.select("key", F.col("orf").alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("strand").alias("d2"))
    both = pairs.join(one, ["key", "a"]).join(two, ["key", "b"])
    lo, hi = F.greatest("s", "s2"), F.least("e", "e2")

    def inside(s, e, d):
        left, right = F.col(s) >= lo, F.col(e) <= hi
        return F.when(left & right, 53).when(left, F.when(F.col(d) > 0, 5).otherwise(3)).when(right, F.when(F.col(d) > 0, 3).otherwise(5)).otherwise(0)

    swap = (F.col("s2") < F.col("s")) | ((F.col("s2") == F.col("s")) & (F.col("e2") > F.col("e")))
    out = both.select("key", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("dst"), overlap_type(inside("s", "e", "d"), inside("s2", "e2", "d2"), F.col("bp"), max_overlap).alias("type"), "bp")
    return out.where("type IS NOT NULL")
