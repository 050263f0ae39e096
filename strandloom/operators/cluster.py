"""Clustering of ORFs by identity to centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import discard, written


def node_centroids(rows: DataFrame, node: str, item: str, length: str) -> DataFrame:
    """(node, centroid): the longest item of each node; ties go to the smallest id."""
    return rows.groupBy(F.col(node).alias("node")).agg(F.min_by(F.col(item), F.struct(-F.col(length), F.col(item))).alias("centroid"))


def identity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


#: Bits of an item's place that count items of its length; those above count down its length.
_BITS, _LONGEST = 36, (1 << 27) - 1


def placed(items: DataFrame) -> DataFrame:
    """(place, item, seq) of items (item, seq), written: places are longs, smaller for longer items, ties by item."""
    by = Window.partitionBy("_l").orderBy("item")
    sized = items.select("item", "seq", F.length("seq").alias("_l"))
    first = F.call_function("shiftleft", (F.lit(_LONGEST) - F.col("_l")).cast("long"), F.lit(_BITS))
    return written(sized.select((first + F.row_number().over(by)).alias("place"), "item", "seq"), "placed")


def _length(place: str) -> Column:
    return F.lit(_LONGEST) - F.call_function("shiftright", F.col(place), F.lit(_BITS))


def _near(items: DataFrame, nodes: DataFrame, len_cutoff: float, id_cutoff: float) -> DataFrame:
    """``centroid_pairs`` of places: items (place, item, seq), nodes (node, place)."""
    by = Window.partitionBy("node").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = nodes.select("place", F.first("place").over(by).alias("first")).where("place <> first")
    pairs = met.where(_length("place") >= len_cutoff * _length("first")).distinct()
    left = items.select(F.col("place").alias("first"), F.col("item").alias("centroid"), F.col("seq").alias("cs"))
    right = items.select("place", F.col("item").alias("member"), F.col("seq").alias("ms"))
    longer = F.greatest(F.length("cs"), F.length("ms"))
    # few bytes, but each row an alignment: dealt over the cores again after the joins
    met = pairs.join(left, "first").join(right, "place").repartition(4 * items.sparkSession.sparkContext.defaultParallelism)
    # the threshold is a column of its own, as the alignment stops there and gives -1
    aligned = met.withColumn("allowed", F.floor((1 - id_cutoff) * longer + 1e-9).cast("int"))
    cut = F.length("cs") - F.length("ms")  # what begins or ends like the longer lacks just the rest
    part = F.col("cs").startswith(F.col("ms")) | F.col("cs").endswith(F.col("ms"))
    within = aligned.withColumn("d", F.when(part, F.when(cut <= F.col("allowed"), cut).otherwise(-1)).otherwise(F.expr("levenshtein(cs, ms, allowed)"))).where("d >= 0")
    return within.select("centroid", "member", (1 - F.col("d") / longer).alias("identity"))


def centroid_pairs(items: DataFrame, nodes: DataFrame, len_cutoff: float = 0.98, id_cutoff: float = 0.98) -> DataFrame:
    """(centroid, member, identity): items close to the centroid of one of their nodes.

    items (item, seq), nodes (item, node). Each pair is compared once however many nodes it shares, the length ratio
    goes before the pairs are gathered, and the alignment stops at the distance that the cutoff allows. A row of a node
    holds a long that tells the item's length and place among all, so its centroid is the least of them.
    """
    known = placed(items)
    return _near(known, nodes.select("item", "node").join(known.select("item", "place"), "item").select("node", "place"), len_cutoff, id_cutoff)


#: Letters of proteins as numbers of five bits.
_CODES = np.array([ord(c) - 64 if "A" <= c <= "Z" else 27 if c == "*" else 0 for c in map(chr, range(256))], np.int64)


def protein_pairs(items: DataFrame, k: int, len_cutoff: float = 0.98, id_cutoff: float = 0.98) -> DataFrame:
    """``centroid_pairs`` of proteins (item, seq; letters and *) whose nodes are their words of ``k`` letters, 12 at most.

    Words are longs of five bits a letter, so the one shuffle of them has two numbers a row and no text.
    """
    if not 1 <= k <= 12:
        raise ValueError(f"words of {k} letters do not fit a long")
    known = placed(items)

    def cut(batches):
        for batch in batches:
            text = "".join(batch.column(1).to_pylist()).encode("utf-32-le")
            chars = np.frombuffer(text, np.uint32)
            codes = _CODES[np.minimum(chars, 255)]
            if not codes.all():
                raise ValueError("proteins hold letters and * only")
            of = np.repeat(np.arange(batch.num_rows), pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
            n = len(codes) - k + 1
            if n < 1:
                continue
            words = np.zeros(n, np.int64)
            for i in range(k):
                words = words << 5 | codes[i : i + n]
            whole = of[:n] == of[k - 1 :]
            yield pa.RecordBatch.from_arrays([pa.array(words[whole]), batch.column(0).take(pa.array(of[:n][whole]))], ["node", "place"])

    return _near(known, known.select("place", "seq").mapInArrow(cut, "node long, place long"), len_cutoff, id_cutoff)


def greedy(items: DataFrame, pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(centroid, member): items taken longest first (ties: the smaller); one not yet taken becomes a centroid and takes
    its free partners.

    items (item, seq), pairs (centroid, member): who may take whom. The rule is sequential only along links. In each
    round an item is a centroid if nobody is left who could take it, and goes to the first who can once that one is
    known to be a centroid; what has been taken takes nobody. Every round is joins of what is left and is written out, so no
    component of the links has to fit into a task. Rounds are as many as the longest chain of decisions. Items without
    links are centroids of themselves.
    """
    kind = dict(items.dtypes)["item"]
    sized = items.select("item", F.length("seq").alias("len"))
    order = lambda c, n: F.struct((-F.col(n)).alias("l"), F.col(c).alias("i"))
    links = pairs.where("centroid <> member").select("centroid", "member").distinct()
    links = links.join(sized.select(F.col("item").alias("centroid"), F.col("len").alias("cl")), "centroid").join(sized.select(F.col("item").alias("member"), F.col("len").alias("ml")), "member")
    # only those ahead can take an item
    links = written(links.select(order("centroid", "cl").alias("c"), order("member", "ml").alias("m")).where("c < m"), "links")
    found = [items.select(F.col("item").alias("centroid"), F.col("item").alias("member")).join(links.select(F.explode(F.array("c.i", "m.i")).alias("member")).distinct(), "member", "left_anti").select("centroid", "member")]
    left = written(links.select(F.explode(F.array("c", "m")).alias("x")).distinct(), "left")
    links = links.withColumn("settled", F.lit(False))
    for n_round in range(max_rounds):
        if left.isEmpty():
            break
        heads = written(left.join(links.select(F.col("m").alias("x")), "x", "left_anti"), "heads")
        known = links.join(heads.select(F.col("x").alias("c"), F.lit(True).alias("now")), "c", "left").select("c", "m", (F.col("settled") | F.coalesce("now", F.lit(False))).alias("settled"))
        # the first that can take an item has it, once that one is known to be a centroid
        taken = written(known.groupBy(F.col("m").alias("x")).agg(F.min(F.struct("c", "settled")).alias("by")).where("by.settled").select("x", "by.c"), "taken")
        found += [heads.select(F.col("x.i").alias("centroid"), F.col("x.i").alias("member")), taken.select(F.col("c.i").alias("centroid"), F.col("x.i").alias("member"))]
        rest = written(left.join(heads.unionByName(taken.select("x")), "x", "left_anti"), "left")
        now = written(known.join(taken.select(F.col("x").alias("c")), "c", "left_anti").join(taken.select(F.col("x").alias("m")), "m", "left_anti").select("c", "m", "settled"), "links")
        if n_round:
            discard(links)  # the first are still to be read by the result
        discard(left)
        left, links = rest, now
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("centroid").cast(kind), F.col("member").cast(kind))


def all_pairs(members: DataFrame) -> DataFrame:
    """(cluster, a, b), a < b: all pairs of items of a precluster; as many rows as there are pairs, whatever is done.

    members (cluster, item)."""
    other = members.select(F.col("cluster").alias("_c"), F.col("item").alias("b"))
    return members.select("cluster", F.col("item").alias("a")).join(other, (F.col("cluster") == F.col("_c")) & (F.col("a") < F.col("b"))).select("cluster", "a", "b")


def share_scores(clusters: DataFrame, centroid_scores: DataFrame, orfs: DataFrame, start_weight: dict[str, float], gene_weight: float, tis_weight: float, threshold: float, min_score: float) -> DataFrame:
    """Members take their centroid's gene probability but keep their own start, length and start-site probability.

    clusters (centroid, member), centroid_scores (centroid, gene_prob), orfs (member, start_codon, tis_prob, len).
    A centroid below ``min_score`` takes its whole cluster with it.
    """
    start = F.lit(0.0)
    for codon, w in start_weight.items():
        start = F.when(F.col("start_codon") == codon, w).otherwise(start)
    score = (F.col("gene_prob") * gene_weight + F.col("tis_prob") * tis_weight + start - threshold) * F.col("len")
    scored = clusters.join(centroid_scores, "centroid").join(orfs, "member").withColumn("score", score)
    good = scored.where((F.col("member") == F.col("centroid")) & (F.col("score") >= min_score)).select("centroid")
    return scored.join(good, "centroid", "left_semi").where(F.col("score") >= min_score).select("centroid", "member", "score")
