"""Counts of hand-made texts, sketches that merge, and verdicts."""

from pyspark.sql import functions as F

from strandloom.llm import quality
from strandloom.session import written


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")


def test_counts(spark):
    rows = [
        (1, None, "en", "a", ""),
        (2, "", None, None, ""),
        (3, " \n\t", "en", "a", ""),
        (4, "a b c a b c", "en", "a", ""),  # windows abc bca cab abc: positions 0-2 and 3-5
        (5, "x x x x", "en", "a", ""),
        (6, "l one\nl one\n\n \nl two\nl one ", "en", "a", ""),
        (7, "é# ü* <b> |", "en", "a", ""),
        (8, "w " * 40_000, "en", "a", ""),
        (8, "w " * 40_000, "en", "a", ""),
    ]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judged(docs_of(spark, rows)).collect()))
    assert got[:7] == [
        (1, 0, 0, 0, 0, 0, True, False),
        (2, 0, 0, 0, 0, 0, True, False),
        (3, 0, 0, 0, 0, 0, True, False),
        (4, 6, 6, 0, 0, 6, True, False),
        (5, 4, 4, 0, 0, 4, True, False),
        (6, 8, 16, 0, 1, 5, True, False),  # "l one l" at words 0 and 2 covers 0-4
        (7, 4, 8, 5, 0, 0, True, False),
    ]
    assert [g[1:] for g in got[7:]] == [(40_000, 40_000, 0, 0, 40_000, True, False)] * 2


def test_verdicts_adapt_to_the_group(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(240):
        text = " ".join(words[(i * 7 + k * 11) % 300] for k in range(80))
        if i % 2:  # the other source marks every word
            text = " ".join(w + "#" for w in text.split())
        rows.append((i, text, "en", "marked" if i % 2 else "plain", ""))
    rows += [(900, " ".join(w + "#" for w in words[:80]), "en", "plain", ""), (901, " ".join(words[:80]), None, "plain", "")]
    got = {r.doc_id: r.kept for r in quality.judged(docs_of(spark, rows)).collect()}
    assert all(got[i] for i in range(240)) and not got[900]
    kept = quality.filtered(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_words"]
    assert {r.doc_id for r in kept.collect()} == {d for d, k in got.items() if k}
    assert quality.judged(docs_of(spark, rows).limit(0)).count() == 0 and quality.filtered(docs_of(spark, rows).limit(0)).count() == 0
    by_group = {r.source: r for r in quality.thresholds(written(quality.measured(docs_of(spark, rows)), "t")).where("lang = 'en'").collect()}
    assert by_group["marked"].symbols_hi > 1000 > by_group["plain"].symbols_hi > 0


def test_rows_of_one_id_stand_on_their_own(spark):
    good = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(None, good, "en", "a", "1"), (None, "too short", "en", "a", "2"), (5, good + " z", "en", "a", "3"), (5, "short too", "en", "a", "4"), (5, good + " z", "en", "a", "5"), (6, None, None, None, "6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string").withColumnsRenamed({"key": "kept"}).withColumn("row", F.col("kept")).withColumn("key", F.col("kept")).withColumn("_id", F.col("kept"))
    got = quality.filtered(docs)
    assert got.columns == docs.columns and sorted(r._id for r in got.collect()) == ["1", "3", "5"]
