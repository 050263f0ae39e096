"""Node paths of genomes: runs, ends, containment, sequences and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_runs(rows: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """The path of each key with consecutive repeats of a node as one row: pos from 1, contig_end at both ends."""
    by = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn("_p", F.lag(node).over(by)).where(~F.col("_p").eqNullSafe(F.col(node))).drop("_p")
    return kept.withColumns({"pos": F.row_number().over(by), "contig_end": F.lag(F.lit(1)).over(by).isNull() | F.lead(F.lit(1)).over(by).isNull()})


def path_text(rows: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """(keys, path): the nodes of each key in order, between commas, so that containment is a substring test."""
    nodes = F.array_sort(F.collect_list(F.struct(*order, F.col(node).alias("_n"))))
    return rows.groupBy(*keys).agg(F.concat(F.lit(","), F.array_join(F.transform(nodes, lambda x: x["_n"].cast("string")), ","), F.lit(",")).alias("path"))


def node_ranges(nodes: Column, sizes: Column, overlap: int) -> Column:
    """Where each node lies on its path: structs (s, e), the end exclusive; neighbours share ``overlap`` bases."""
    step = F.aggregate(
        F.arrays_zip(nodes.alias("n"), sizes.alias("z")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("r")),
        lambda a, x: F.struct((a["at"] + x["z"] - overlap).cast("int").alias("at"), F.concat(a["r"], F.array(F.struct(a["at"].alias("s"), (a["at"] + x["z"]).cast("int").alias("e")))).alias("r")),
    )
    return step["r"]


def to_nodes(start: Column, end: Column, nodes: Column, ranges: Column) -> Column:
    """Path coordinates [start, end) as (node, s, e) within nodes, the end exclusive; untouched nodes go."""
    each = F.transform(F.arrays_zip(nodes.alias("n"), ranges.alias("r")), lambda x: F.struct(x["n"].alias("node"), (F.greatest(start, x["r"]["s"]) - x["r"]["s"]).alias("s"), (F.least(end, x["r"]["e"]) - x["r"]["s"]).alias("e")))
    return F.filter(each, lambda x: x["e"] > x["s"])


def placed_nodes(steps: DataFrame, keys: list[str], order: list[str], size: str, overlap: int) -> DataFrame:
    """``steps`` with s and e, where each node lies on its path: a running sum, for paths of any length."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col(size) - overlap).over(before), F.lit(0))
    return steps.withColumn("s", at.cast("long")).withColumn("e", F.col("s") + F.col(size))


def simplify(coords: Column, overlap: int) -> Column:
    """Without the leading and trailing nodes that an ORF covers only within the overlap; inner ones stay."""
    covers = F.transform(coords, lambda x: x["e"] - x["s"] > overlap)
    first = F.array_position(covers, True).cast("int")
    last = F.size(coords) - F.array_position(F.reverse(covers), True).cast("int") + 1
    return F.when(first > 0, F.slice(coords, first, last - first + 1)).otherwise(F.slice(coords, 1, 0))


def reverse_coords(coords: Column, sizes: Column) -> Column:
    """An ORF read on the other strand: its nodes in reverse order and sign, with the places counted from their ends."""
    each = F.transform(F.arrays_zip(coords.alias("c"), sizes.alias("z")), lambda x: F.struct((-x["c"]["node"]).alias("node"), (x["z"] - x["c"]["e"]).alias("s"), (x["z"] - x["c"]["s"]).alias("e")))
    return F.reverse(each)


def order_in_node(coords: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, s, e, pos): ORFs in the order they begin in each unsigned node; coords (keys, node, s, e) places on
    the node's own strand. Ties go to the one that ends first, then to the lesser key."""
    by = Window.partitionBy("node").orderBy("s", "e", *keys)
    return coords.select(*keys, F.abs("node").alias("node"), "s", "e").withColumn("pos", F.row_number().over(by))


def longest_path(paths: DataFrame, keys: list[str], length: str, value: str) -> DataFrame:
    """(keys, value, length): of several real paths the longest, ties to the smallest value."""
    return paths.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col(length), F.col(value))).alias(value), F.max(length).alias(length))


def drop_short(coords: Column, overlap: int) -> Column:
    """Nodes of which an ORF covers more than the overlap."""
    return F.filter(coords, lambda x: x["e"] - x["s"] > overlap)


def path_sequence(paths: DataFrame, unitigs: DataFrame, keys: list[str], overlap: int) -> DataFrame:
    """(keys, seq): paths (keys, coords array<struct<node,s,e>>) spelled with unitigs (node_id > 0, seq).

    The first node gives [s, e), later ones what lies beyond the overlap; a negative node is read on the other strand.
    """
    from strandloom.functions.sequence import reverse_complement

    parts = paths.select(*keys, F.posexplode("coords").alias("_i", "_c"))
    joined = parts.join(unitigs.select("node_id", F.col("seq").alias("_seq")), F.abs("_c.node") == F.col("node_id"))
    strand = F.when(F.col("_c.node") < 0, reverse_complement(F.col("_seq"))).otherwise(F.col("_seq"))
    first = F.when(F.col("_i") == 0, F.col("_c.s")).otherwise(F.greatest(F.col("_c.s"), F.lit(overlap)))
    cut = joined.select(*keys, F.struct(F.col("_i").alias("i"), F.substr(strand, first + 1, F.greatest(F.col("_c.e") - first, F.lit(0))).alias("piece")).alias("_x"))
    return cut.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["piece"]), "").alias("seq"))
