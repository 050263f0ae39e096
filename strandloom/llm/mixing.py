"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import SPACE
from strandloom.llm.registry_base import register
from strandloom.session import table, written

#: Weights of the sources in code point order, repeating; no source is taken more often than MAX_EPOCHS times.
WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"


def size_of(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.regexp_replace(t, r"^[\x20\x09-\x0D]+", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE)) - F.when(t.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def targets(source_sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``weight`` and ``target`` (double): words to take of each source.

    Water-filling in closed form. Sources with the least cap per weight fill up first; with the k first of them held
    at their caps, the rest share what is left by weight, and the right k is the first one at which nobody is above
    its cap. That is where clamping and resharing round by round ends. The windows run over one row per source.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = source_sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % n).cast("long"))
    capped = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("long"))
    # the order of cap / weight
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    held = capped.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("level", F.col("left") / F.col("open"))
    # a source is free from the first one on whose cap is not below its share
    held = held.withColumn("free_level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    final = held.withColumn("final", F.first("free_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return final.select("source", "source_size", "weight", F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mixing_plan(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size, h: the seeded hash) -> per source: source_size, target, ``whole`` and ``cut``.

    A row is taken ``whole`` = floor(target / source_size) times, and once more if its hash is not above ``cut``: rows in hash order until the words are nearest the target, so to within half a document. To find the cut
    without sorting a hot source in one task, words are first summed by 4,096 hash ranges, which combines before the
    shuffle; only rows of the one range with the cut, a 4,096th of a source, are ranked.
    """
    hashed = sized.select("source", "size", "h").withColumn("b", F.substring("h", 1, 3))
    sums = hashed.groupBy("source", "b").agg(F.sum("size").alias("w"))
    per_source = targets(sums.groupBy("source").agg(F.sum("w").alias("source_size")), weights, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per_source = per_source.withColumn("whole", rate).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    ranges = sums.select(F.col("source").alias("s"), "b", "w", F.sum("w").over(run).alias("upto")).join(per_source.select("source", "need"), F.col("s").eqNullSafe(F.col("source"))).drop("source")
    first = ranges.where("upto > need").groupBy("s", "need").agg(F.min(F.struct("b", (F.col("upto") - F.col("w")).alias("below"))).alias("c")).select("s", "need", F.col("c.b").alias("cut_b"), F.col("c.below").alias("below"))
    within = hashed.join(first, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("cut_b"))).select("s", "h", "size", "need", "below")
    upto = F.col("below") + F.sum("size").over(Window.partitionBy("s").orderBy("h"))
    last = within.withColumn("at", upto - F.col("size") / 2).where("at <= need").groupBy("s").agg(F.max("h").alias("cut_h"))
    cuts = first.join(last.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", F.coalesce("cut_h", "cut_b").alias("cut"))
    # no range passes the need only if rounding puts it at the very end: then all rows are taken
    return per_source.join(cuts, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.when(F.col("need") > 0, "g").otherwise("")).alias("cut"))


def seeded(doc_id: Column, text: Column, seed: str) -> Column:
    """A row's place in the random order: the seeded hash of its id, then the hash of its text. Rows without an id go
    by their text, so they do not share a place."""
    own = F.md5(F.coalesce(text, F.lit("")))
    return F.concat(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), own))), own)


def with_times(rows: DataFrame, plan: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``rows`` (source, h, ...) with source_size, target and times. The plan has a row per source; it is broadcast
    only after counting that they are few, and joined by shuffle otherwise."""
    plan = written(plan, "mixing-plan").withColumnRenamed("source", "_source")
    few = plan.count() <= 100_000
    joined = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source")))
    # texts without words weigh nothing, so no cut by words holds them: the epochs do
    again = (F.col("h") <= F.col("cut")).cast("long")
    return joined.withColumn("times", F.least(F.col("whole") + again, F.lit(max_epochs))).drop("_source", "whole", "cut", "h")


def placed(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), seeded(F.col("doc_id"), F.col("text"), seed).alias("h"))


def mix_sizes(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, times for every row of ``docs`` (doc_id, text, source).

    Null sources are one source. Rows are ordered by a seeded hash of the doc_id, ties under one id and rows without
    one by their text; only rows equal in both stand or fall together. Null and empty texts have size 0 and are taken
    as often as a row at their place, at most ``max_epochs`` times like all. An empty table gives an empty result;
    other columns of ``docs`` are not read.
    """
    sized = written(placed(docs, seed), "sizes")
    return with_times(sized, mixing_plan(sized, weights, max_epochs), max_epochs)


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken.

    Nulls, empty texts, ties, repeated rows and empty tables are treated as in ``mix_sizes``, and columns of any name
    may be there. Texts are never shuffled: whether a row is taken depends on its own hash and its source's line of
    the plan.
    """
    plan = mixing_plan(written(placed(docs, seed), "sizes"), weights, max_epochs)
    boxed = docs.select("source", seeded(F.col("doc_id"), F.col("text"), seed).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = with_times(boxed, plan, max_epochs).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) || md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST) AS k FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM o),
f AS (SELECT min(k) AS k FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, source_size, CASE WHEN l.k < f.k THEN cap::DOUBLE ELSE (SELECT level FROM l l2, f f2 WHERE l2.k = f2.k) * weight END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
u AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) - d.size / 2.0 AS reach FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN reach <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM u"""


@register("op9_mix_sources", MIX_SQL)
def op9_mix_sources(spark, sf_dir):
    out = mix_sizes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
