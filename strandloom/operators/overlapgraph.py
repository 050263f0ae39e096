"""The best chain of genes in each component of an overlap graph, without coordinates: by waves through the graph.

An edge leads from an ORF to one that it overlaps and that lies after it. A chain may go on with any ORF that can be
reached from its last one: at a cost by kind and length if the two overlap, not at all if they are incompatible, and
freely otherwise. A wave settles the ORFs all of whose predecessors are settled, as joins, and is written out; no
component, however dense, has to fit into a task. Cycles that stop the wave are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators import dbg
from strandloom.operators.bestpath import PENALTY
from strandloom.operators.components import components
from strandloom.session import Pile, discard, written


def penalty(kind: Column, bp: Column) -> Column:
    """Cost of an overlap; null if the two cannot follow each other."""
    out = F.lit(None).cast("double")
    for k, v in PENALTY.items():
        out = F.when(kind == k, bp * F.lit(v)).otherwise(out)
    return out


def labelled(edges: DataFrame) -> DataFrame:
    """(v, from, to): the smallest node that reaches each node of edges (a, b), and the smallest that it reaches, itself
    included; in rounds until nothing moves."""
    nodes = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    state = written(nodes.select("v", F.col("v").alias("from"), F.col("v").alias("to")), "labels")
    while True:
        known = lambda v, x: state.select(F.col("v").alias(v), F.col(x).alias("_x"))
        down = edges.join(known("a", "from"), "a").groupBy(F.col("b").alias("v")).agg(F.min("_x").alias("_f"))
        up = edges.join(known("b", "to"), "b").groupBy(F.col("a").alias("v")).agg(F.min("_x").alias("_t"))
        moved = F.coalesce(F.col("_f") < F.col("from"), F.lit(False)) | F.coalesce(F.col("_t") < F.col("to"), F.lit(False))
        new = state.join(down, "v", "left").join(up, "v", "left").select("v", F.least("from", "_f").alias("from"), F.least("to", "_t").alias("to"), moved.alias("moved"))
        last, state = state, written(new, "labels")
        discard(last)
        if state.where("moved").isEmpty():
            return state.select("v", "from", "to")


def cut_cycles(edges: DataFrame) -> DataFrame:
    """Edges (a, b, ...) without cycles: within a strongly connected component those from a larger to a smaller node go,
    one of which every cycle has.

    Nodes that the same node reaches and that reach it are one component with it. Edges between nodes whose labels
    differ are in no cycle and leave, and the rest is labelled again, so a pass settles the smallest nodes at least.
    """
    work, cut = written(edges.select("a", "b"), "work"), Pile(edges.sparkSession, "cycle-edges")
    while not work.isEmpty():
        labels = labelled(work)
        side = lambda v: labels.select(F.col("v").alias(v), F.col("from").alias(f"_f{v}"), F.col("to").alias(f"_t{v}"))
        same = written(work.join(side("a"), "a").join(side("b"), "b").where("_fa = _fb AND _ta = _tb").select("a", "b", (F.col("_fa") == F.col("_ta")).alias("one")), "same")
        cut.add(same.where("one AND a >= b").select("a", "b"))
        discard(work)
        work = written(same.where("NOT one").select("a", "b"), "work")
    return edges.join(cut.read(work.schema).select("a", "b"), ["a", "b"], "left_anti") if cut.rounds else edges


def settled(scores: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, best, back): the best chain that ends at each node, and the node before it there; and the edges without those
    that were cut because of cycles, which are looked for only among what a wave cannot reach.

    scores (v, score), edges (a, b, cost), each pair once; a null cost forbids it. What a node hands on is the best
    of its ancestors, as many as the largest number of edges into a node and one: of so many one at least is left when
    those that overlap a node are taken out, so no other ancestor can be its best free one. Ties go to the smaller node.
    """
    into = edges.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    done, left, rest = Pile(scores.sparkSession, "settled"), written(scores, "open"), written(edges, "open-edges")
    kept, every = edges, None
    while not left.isEmpty():
        ready = left.join(rest.select(F.col("b").alias("v")).distinct(), "v", "left_anti")
        if every is not None:
            old = every.select(F.col("v").alias("a"), "best", "top")
            met = kept.join(ready.select(F.col("v").alias("b")), "b").join(old, "a")
            came = met.groupBy(F.col("b").alias("v")).agg(F.collect_list(F.struct("a", "best", "cost")).alias("p"), F.array_distinct(F.flatten(F.collect_list("top"))).alias("above"))
            now = ready.join(came, "v", "left")
        else:
            now = ready.withColumns({"p": F.lit(None).cast("array<struct<a: long, best: double, cost: double>>"), "above": F.lit(None).cast("array<struct<less: double, v: long>>")})
        p, above = F.coalesce("p", F.array().cast("array<struct<a: long, best: double, cost: double>>")), F.coalesce("above", F.array().cast("array<struct<less: double, v: long>>"))
        now = now.select("v", "score", p.alias("p"), above.alias("above"))
        direct = F.transform(F.filter("p", lambda x: x["cost"].isNotNull()), lambda x: F.struct((x["cost"] - x["best"]).alias("less"), x["a"].alias("v")))
        other = F.filter("above", lambda x: ~F.exists("p", lambda y: y["a"] == x["v"]))
        first = F.array_min(F.filter(F.concat(direct, other), lambda x: x["less"] < 0))  # most first, then the smaller node
        chosen = now.select("v", "score", "above", first.alias("first")).withColumn("best", F.col("score") - F.coalesce("first.less", F.lit(0.0)))
        own = F.array(F.struct((-F.col("best")).alias("less"), F.col("v").alias("v")))
        wave = done.add(chosen.select("v", "best", F.col("first.v").alias("back"), F.slice(F.array_sort(F.concat("above", own)), 1, into + 1).alias("top")))
        every = done.read(wave.schema)
        if wave.isEmpty():  # all that is left is in a cycle or after one
            free = written(cut_cycles(rest), "open-edges")
            kept = written(kept.join(rest.join(free, ["a", "b"], "left_anti").select("a", "b"), ["a", "b"], "left_anti"), "edges")
            rest = free
            continue
        new_left, new_rest = written(left.join(wave.select("v"), "v", "left_anti"), "open"), written(rest.join(wave.select(F.col("v").alias("a")), "a", "left_anti"), "open-edges")
        discard(left, rest)
        left, rest = new_left, new_rest
    if every is None:
        return scores.select("v", F.col("score").alias("best"), F.lit(None).cast("long").alias("back")), kept
    return every.select("v", "best", "back"), kept


def traced(ends: DataFrame, backs: DataFrame) -> DataFrame:
    """(v): the nodes on the ways back from ``ends`` (v) along backs (v, back). Every round doubles the steps of a jump
    and adds where all nodes known so far jump to."""
    on, jump = written(ends.select("v"), "on"), written(backs.where("back IS NOT NULL").select("v", "back"), "jumps")
    while not jump.isEmpty():
        more = written(on.union(on.join(jump, "v").select("back")).distinct(), "on")
        far = jump.select(F.col("v").alias("back"), F.col("back").alias("next"))
        then = written(jump.join(far, "back").select("v", F.col("next").alias("back")), "jumps")
        discard(on, jump)
        on, jump = more, then
    return on


def best_gene_paths(orfs: DataFrame, overlaps: DataFrame, min_score: float = 100.0) -> DataFrame:
    """(key, orf, total): the ORFs of the best chain of each component, and what it scores, where that is ``min_score``
    or more. orfs (key, orf, score), overlaps (key, src, dst, type, bp); repeated overlaps count by their first in order.

    An ORF that overlaps none is a component of its own. Overlaps of ORFs that are not there, or of one with itself, are
    left out; a null score counts as 0.
    """
    ids = written(dbg.dense_ids(orfs.select("key", "orf", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).withColumn("k", F.struct("key", "orf")), "k", "v").drop("k"), "ids")
    end = lambda c, v: ids.select("key", F.col("orf").alias(c), F.col("v").alias(v))
    edges = overlaps.join(end("src", "a"), ["key", "src"]).join(end("dst", "b"), ["key", "dst"]).where("a <> b").groupBy("a", "b").agg(F.min(F.struct("type", "bp")).alias("o"))
    edges = written(edges.select("a", "b", penalty(F.col("o.type"), F.col("o.bp")).alias("cost")), "edges")
    done, edges = settled(ids.select("v", "score"), edges)
    done = written(done, "settled")
    of = components(edges.select("a", "b")).select(F.col("node").alias("v"), "component")
    whole = done.join(of, "v", "left").withColumn("component", F.coalesce("component", "v"))
    top = written(whole.groupBy("component").agg(F.min(F.struct((-F.col("best")).alias("less"), F.col("v"))).alias("x")).where(-F.col("x.less") >= min_score).select("component", "x.v", (-F.col("x.less")).alias("total")), "ends")
    on = traced(top, done.select("v", "back")).join(whole.select("v", "component"), "v").join(top.select("component", "total"), "component")
    return on.join(ids, "v").select("key", "orf", "total")
