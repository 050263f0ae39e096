"""Line templates against plain loops, and edge cases."""

import random

from strandloom.llm import common, linededup
from tests.llm.plain import dedup_lines


def corpus():
    random.seed(9)
    vocab = [f"w{chr(97 + i)}" for i in range(26)] + ["é", "x9", "7"]
    line = lambda k: " ".join(random.choices(vocab, k=k))
    shared = [line(k) for k in (2, 4, 9, 20, 60)]
    rows = []
    for i in range(80):
        parts = [line(random.randint(1, 30)) for _ in range(random.randint(0, 6))]
        parts += random.sample(shared, random.randint(0, 2))
        if i % 3 == 0:
            parts.append(f"Page {i} of {i * 7} was printed")
        if i % 4 == 0:  # one field of a long line varies
            parts.append("dear customer your order number is " + line(1) + " and it leaves our house on the next day we work thank you")
        random.shuffle(parts)
        rows.append((i, random.choice(["\n", "\n", "\n \n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (103, "a" * 100_000 + "\n" + "1" * 100_000), (104, "tail \t" + shared[3] + "\r\n")]
    rows += [(105, rows[5][1]), (106, ("same line again and\n") * 2000)]
    return rows


def test_equals_plain(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, leaf string, n int")
    got = linededup.deduplicated(docs.repartition(5))
    assert got.columns == ["doc_id", "text", "leaf", "n", "n_lines_", "n_dropped_"]
    assert {r.doc_id: (r.text, r.n_lines_, r.n_dropped_) for r in got.collect()} == dedup_lines(rows)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "one line of several words here"), (1, "one line of several words here"), (None, "another line with enough words"), (2, "only here and nowhere else\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(linededup.deduplicated(docs).select("text").toPandas()["text"]) == sorted(t for _, t in rows)
    assert linededup.deduplicated(docs.limit(0)).count() == 0


def test_null_ids_two_texts_and_clashing_names(spark):
    rows = [(None, "a line that all of these have\nmine alone is this one", "m"), (None, "a line that all of these have\nand this is another", "m"), (7, "a line that all of these have", None), (7, "seven has this text as well", "k")]
    docs = spark.createDataFrame([(*r, r[2], r[2], 1, 2) for r in rows], "doc_id long, text string, _key string, ra string, gone string, _n int, parts int")
    got = linededup.deduplicated(docs).collect()
    # of the null ids the lesser key has the first line; names of the operator's own columns are as they were
    texts = sorted(r.text for r in got)
    assert texts.count("") == 1 and sum(t.count("a line that all") for t in texts) == 1 and "seven has this text as well" in texts
    assert sorted((r._key or "", r.ra or "", r.gone or "", r._n, r.parts) for r in got) == sorted((r[2] or "", r[2] or "", r[2] or "", 1, 2) for r in rows)


def whole(spark, rows, **how):
    out = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how)
    return {r.doc_id: r.text for r in out.collect()}


def test_values_in_two_documents_or_one(spark):
    line = "dear customer your order for {} has left our house and it will be with you in the next days thank you"
    names = [a + b for a in "abcde" for b in "vwxyz"]
    for times in (1, 2):
        rows = [(i * times + j, line.format(v)) for i, v in enumerate(names) for j in range(times)]
        rows.append((1000, line.format("lone")))
        assert [d for d, t in whole(spark, rows).items() if t] == [0]
    assert not any(whole(spark, rows, keep_first=False).values())


def test_short_lines(spark):
    for line, kept in (("posted in the News by {} this very morning here", 1), ("{} posted this in the News today", 25)):  # the tree's leading tokens stay apart
        names = [a + b for a in "abcde" for b in "vwxyz"]
        rows = [(2 * i + j, line.format(v)) for i, v in enumerate(names) for j in range(2)]
        assert sum(t != "" for t in whole(spark, rows).values()) == kept
    # two of five words are too many to vary
    rows = [(i, f"read more about {a} {b}") for i, (a, b) in enumerate([("aa", "bb"), ("cc", "dd"), ("ee", "ff")])]
    assert whole(spark, rows) == dict(rows)


def test_hot_template_is_joined_like_any(spark, monkeypatch):
    rows = [(i, f"the very same line in all of them\nand one of its own {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]} xx") for i in range(60)]
    want = dedup_lines(rows)
    for least in (256, 1):
        monkeypatch.setattr(common, "LEAST_HOT", least)
        monkeypatch.setattr(common, "HOT_SHARE", 0.02)
        assert whole(spark, rows) == {d: t for d, (t, _, _) in want.items()}
