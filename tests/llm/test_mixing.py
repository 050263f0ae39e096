"""Water-filling against a round-by-round version, and the mix's edge cases."""

import random
from collections import Counter

from strandloom.llm.mixing import mix, mix_sizes, size_of
from pyspark.sql import functions as F


def by_rounds(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, got, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(got.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return got | share
        got |= {s: cap * sizes[s] for s in over}
        free -= over
    return got


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_targets_and_taken_words(spark):
    random.seed(3)
    rows = []
    for i in range(900):
        s = random.choice(["a", "a", "a", "a", "b", "c", "d", None, "Z"])
        rows.append((i, " ".join(["w"] * random.randint(0, 60)), s, "clash"))
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(t.split())
    want = by_rounds(sizes)
    out = mix_sizes(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        assert 0 <= r.times <= 3
        taken[r.source] += r.size * r.times
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mix_sizes(docs_of(spark, rows[::-1]).repartition(5)).collect()
    assert {(r.doc_id, r.times) for r in out} == {(r.doc_id, r.times) for r in again}
    whole = mix(docs_of(spark, rows))
    assert whole.columns == ["doc_id", "text", "source", "size"]
    assert Counter(r.doc_id for r in whole.collect()) == Counter({r.doc_id: r.times for r in out if r.times})


def test_edges(spark):
    rows = [(1, None, None, ""), (2, "", "a", ""), (3, " \t\r\n\x0b\x0c ", "a", ""), (None, "x y", "a", ""), (4, "x " * 50_000, "b", ""), (4, "x " * 50_000, "b", "")]
    out = mix_sizes(docs_of(spark, rows)).collect()
    assert len(out) == 6 and sum(r.size for r in out) == 100_002
    assert mix_sizes(docs_of(spark, rows).limit(0)).count() == 0
    blank = mix_sizes(docs_of(spark, rows[:3])).collect()
    assert [r.target for r in blank] == [0.0] * 3


def test_size_counts_code_points_of_blanks_only(spark):
    texts = ["a b", " ", " a  b ", "\x1ca", "\n", "a\n", None, "x\u0085y z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(size_of(F.col("t"))).collect()] == [1, 1, 2, 1, 0, 1, 0, 2]


def test_empty_texts_of_a_capped_source_and_rows_without_ids(spark):
    random.seed(4)
    rows = [(i, None if i % 3 else "", "a", "") for i in range(60)] + [(100 + i, "a few words", "a", "") for i in range(5)]
    rows += [(None, " ".join(["w", str(i)] * random.randint(1, 40)), "b", "") for i in range(400)] + [(3000, f"same id {i} " * 5, "c", "") for i in range(300)]
    sized = mix_sizes(docs_of(spark, rows)).collect()
    assert max(r.times for r in sized) == 3 and {r.times for r in sized if r.source == "a"} == {3}
    for s in "bc":
        own = [r for r in sized if r.source == s]
        assert abs(sum(r.size * r.times for r in own) - own[0].target) <= 80
    clash = docs_of(spark, rows).withColumns({"row": F.lit(1), "h": F.lit(2), "times": F.lit(3), "_source": F.lit(4)})
    mixed = mix(clash)
    assert mixed.columns == clash.columns and mix(clash.limit(0)).count() == 0
    assert Counter(r.source for r in mixed.collect()) == Counter({s: sum(r.times for r in sized if r.source == s) for s in "abc"})
    assert mixed.where("row = 1 AND h = 2 AND times = 3 AND _source = 4").count() == mixed.count()
