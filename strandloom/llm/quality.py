"""Quality rules with thresholds that adapt to each language and source, in DataFrame operations only.

The sketch is a histogram of integers that keep their six leading bits: its bucket counts add, so partial sketches
merge by summing, in any order and grouping, and a quantile is off by less than one part in 32. Sketches of a language
and of everything come from merging those of (language, source).

A fence lies FENCE spreads beyond a group's outer decile. The spread is what the decile is from the median, or what one
event (a symbol, an equal line, a window found twice) makes in a short text of the group, whichever is more: most texts
have no event at all, and the quantiles of such a measure are zero. Small groups borrow from their language, and small
languages from everything, as if PRIOR_TEXTS texts of the wider sketch were among their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import row_key, words
from strandloom.llm.registry_base import register
from strandloom.session import table, written

#: Measures, in thousandths: (name, numerator, denominator, what one event adds to the numerator, has a lower fence).
#: A window that is found twice makes six repeated words.
MEASURES = (
    ("word_length", "word_chars", "n_words", 1, True),
    ("symbols", "n_symbols", "n_words", 1, False),
    ("exclaims", "n_exclaims", "n_words", 1, False),
    ("dup_lines", "n_dup_lines", "n_lines", 1, False),
    ("repeats", "n_repeat_words", "n_words", 6, False),
)
#: Sizes that have sketches of their own, for their lower decile: how long a short text is.
SIZES = ("n_words", "n_lines")
FENCE, PRIOR_TEXTS = 4, 100
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, key and the counts of every text; one row per row of ``docs``, null texts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select("doc_id", "lang", "source", row_key("lang", "source", "text").alias("key"), text.alias("t"), words(F.col("text")).alias("w"), lines.alias("l"))
    base = cut.select(
        "doc_id", "lang", "source", "key", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    none = F.array().cast("array<bigint>")
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(none)
    hashed = base.withColumn("g", windows).drop("w")
    # most texts repeat no window and stop here; the others sort (hash, position) and look at their neighbours
    some = hashed.withColumn("g", F.when(F.size("g") > F.size(F.array_distinct("g")), F.col("g")).otherwise(none))
    placed = some.withColumn("g", F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = F.filter(F.transform("g", lambda x, k: F.when((x.h == F.try_element_at("g", k + 2).h) | ((k > 0) & (x.h == F.try_element_at("g", F.greatest(k, F.lit(1))).h)), x.i)), lambda i: i.isNotNull())
    at = placed.withColumn("g", F.sort_array(twice))
    covered = F.aggregate("g", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a.last)).alias("n")), lambda a: a.n)
    counted = at.withColumn("n_repeat_words", covered).drop("g")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def measure(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.floor(F.col(num) * 1000 / F.col(den))).otherwise(F.lit(0)).cast("long")


def sketch(counts: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable histograms of the texts that meet the base rules."""
    each = [F.struct(F.lit(name).alias("measure"), measure(num, den).alias("v")) for name, num, den, _, _ in MEASURES] + [F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in SIZES]
    values = counts.where("not base_failed").select("lang", "source", F.explode(F.array(*each)).alias("m")).select("lang", "source", "m.measure", "m.v")
    return values.withColumn("bucket", F.expr("shiftleft(shiftright(v, greatest(length(bin(v)) - 6, 0)), greatest(length(bin(v)) - 6, 0))")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def deciles(hist: DataFrame, keys: list[str], suffix: str = "") -> DataFrame:
    """First and last decile and median per keys and measure from merged histograms; all but ``keys`` named with ``suffix``."""
    merged = hist.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    at = [F.min(F.when(F.col("upto") * 10 >= F.col("all") * k, F.col("bucket"))).alias(f"q{k}{suffix}") for k in (1, 5, 9)]
    return upto.groupBy(*keys, F.col("measure").alias(f"measure{suffix}")).agg(F.first("all").alias(f"n{suffix}"), *at)


def thresholds(counts: DataFrame) -> DataFrame:
    """One row per (lang, source): <measure>_lo and <measure>_hi."""
    hist = written(sketch(counts), "sketches")
    own, whole = deciles(hist, ["lang", "source"]), deciles(hist, [], "_a")
    of_lang = deciles(hist, ["lang"], "_l").withColumnRenamed("lang", "lang_l")
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("measure") == F.col("measure_l"))).join(whole, F.col("measure") == F.col("measure_a"))
    borrow = lambda n, q, wider: F.floor((F.col(n) * F.col(q) + PRIOR_TEXTS * F.col(wider)) / (F.col(n) + PRIOR_TEXTS))
    for k in (1, 5, 9):
        joined = joined.withColumn(f"q{k}_l", borrow("n_l", f"q{k}_l", f"q{k}_a")).withColumn(f"q{k}", borrow("n", f"q{k}", f"q{k}_l"))
    at = lambda name, q: F.max(F.when(F.col("measure") == name, F.col(q)))
    columns = [at(name, f"q{k}").alias(f"{name}_{k}") for name in (*[m[0] for m in MEASURES], *SIZES) for k in (1, 5, 9)]
    wide = joined.groupBy("lang", "source").agg(*columns)
    fences = []
    for name, _, den, event, lower in MEASURES:
        event_makes = F.floor(F.lit(1000 * event) / F.greatest(F.col(f"{den}_1"), F.lit(1)))
        up, down = F.greatest(F.col(f"{name}_9") - F.col(f"{name}_5"), event_makes), F.greatest(F.col(f"{name}_5") - F.col(f"{name}_1"), event_makes)
        fences += [(F.col(f"{name}_1") - FENCE * down if lower else F.lit(0)).alias(f"{name}_lo"), (F.col(f"{name}_9") + FENCE * up).alias(f"{name}_hi")]
    return wide.select("lang", "source", *fences)


def judged(docs: DataFrame) -> DataFrame:
    """The counts of every text with ``key``, base_failed, kept, and the names of the measures ``beyond`` their fences.

    A text is kept if it meets the base rules and each measure lies within its group's fences. Null lang and source
    are groups of their own. Repeated rows count as often as they occur and each get a row, whatever their doc_id; a
    blank text has no words and fails the base rules; an empty table gives an empty result; other columns are not
    read. Texts are read once: only their counts are written, and everything after works on those. The thresholds have
    a row per group; they are broadcast only after counting that they are few.
    """
    counts = written(measured(docs), "quality")
    limits = written(thresholds(counts), "thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    few = limits.count() <= 100_000
    joined = counts.join(F.broadcast(limits) if few else limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    outside = [F.when(~measure(num, den).between(F.col(f"{name}_lo"), F.col(f"{name}_hi")), F.lit(name)) for name, num, den, _, _ in MEASURES]
    beyond = F.when(~F.col("base_failed"), F.array_compact(F.array(*outside))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("beyond", beyond).withColumn("kept", ~F.col("base_failed") & (F.size("beyond") == 0)).select(*counts.columns, "kept", "beyond")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    A verdict depends on the text, its language and its source alone, and rows find theirs by a key of these three, so
    null or repeated doc_ids and rows that occur twice each stand on their own. Columns of any name may be there. An
    empty table gives an empty result.
    """
    kept = judged(docs).where("kept").select("key").distinct()
    boxed = docs.select(row_key("lang", "source", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return boxed.join(kept, "key", "left_semi").select("row.*")


def _sql_measure(num, den):
    return f"CASE WHEN {den} > 0 THEN floor({num} * 1000 / {den})::BIGINT ELSE 0 END"


def _sql_deciles(name, keys):
    at = ", ".join(f"min(bucket) FILTER (k * 10 >= n * {q}) AS q{q}" for q in (1, 5, 9))
    return f"{name} AS (SELECT {keys}, any_value(n) AS n, {at} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bucket) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM s) GROUP BY {keys})"


def _sql_borrow(own, wider, q):
    return f"({own}.n * {own}.q{q} + {PRIOR_TEXTS} * {wider}.q{q}) // ({own}.n + {PRIOR_TEXTS}) AS q{q}"


_SHIFT = "greatest(length(bin(v)) - 6, 0)"
QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
b AS (SELECT r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_exclaims, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM w),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, sum(least(3, i - last)) AS n_repeat_words FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -3) AS last FROM h WHERE n > 1) GROUP BY r),
c AS (SELECT b.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
v AS ({' UNION ALL '.join([f"SELECT r, lang, source, base_failed, '{n}' AS measure, {_sql_measure(a, b)} AS v FROM f" for n, a, b, _, _ in MEASURES] + [f"SELECT r, lang, source, base_failed, '{c}', {c} FROM f" for c in SIZES])}),
s AS (SELECT lang, source, measure, ((v >> {_SHIFT}) << {_SHIFT}) AS bucket FROM v WHERE NOT base_failed),
{_sql_deciles('o', 'lang, source, measure')},
{_sql_deciles('y', 'lang, measure')},
{_sql_deciles('a', 'measure')},
z AS (SELECT y.lang, y.measure, {', '.join(_sql_borrow('y', 'a', k) for k in (1, 5, 9))} FROM y JOIN a USING (measure)),
q AS (SELECT o.lang, o.source, o.measure, {', '.join(_sql_borrow('o', 'z', k) for k in (1, 5, 9))} FROM o JOIN z ON o.lang IS NOT DISTINCT FROM z.lang AND o.measure = z.measure),
m(measure, den, event, low) AS (VALUES {', '.join(f"('{n}', '{d}', {k}, {str(low).upper()})" for n, _, d, k, low in MEASURES)}),
e AS (SELECT q.*, 1000 * event // greatest(short.q1, 1) AS makes, low FROM q JOIN m USING (measure) JOIN q short ON short.measure = m.den AND q.lang IS NOT DISTINCT FROM short.lang AND q.source IS NOT DISTINCT FROM short.source),
x AS (SELECT v.r, count(*) AS n_inside FROM v JOIN e ON v.measure = e.measure AND v.lang IS NOT DISTINCT FROM e.lang AND v.source IS NOT DISTINCT FROM e.source
  WHERE v.v <= q9 + {FENCE} * greatest(q9 - q5, makes) AND v.v >= CASE WHEN low THEN q1 - {FENCE} * greatest(q5 - q1, makes) ELSE 0 END GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(n_inside, 0) = {len(MEASURES)} AS kept FROM f LEFT JOIN x USING (r)"""


@register("op5_quality_rules", QUALITY_SQL)
def op5_quality_rules(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
