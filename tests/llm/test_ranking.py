"""Pairwise quality ranking: held-out accuracy, pairs and likelihood by definition, and edge cases."""

import random
import zlib

import numpy as np
import pytest

from strandloom.llm import ranking


@pytest.fixture(scope="module")
def made(spark):
    random.seed(5)
    vocab = ["".join(random.choices("aeiourstln", k=random.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        words = random.choices(vocab, k=random.randint(5, 300))
        bad = i % 7 == 0
        if bad:
            words = [[w.upper() + "!!" for w in words], [w + "%%%" for w in words], [w for w in words for _ in range(9)]][i // 7 % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    labels += [(4, None, None), (None, 1, 1), (5, 1, 1), (8, 1, 0)]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, m string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, lab, rows, ranking.train(docs, lab)


def test_held_out_accuracy(made):
    docs, _, rows, model = made
    got = {r.doc_id: r for r in ranking.scored(docs, model).collect()}
    fold = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == (i % 7 != 0) for i in fold) / len(fold) > 0.99
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_sample_leaves_out_the_fold_and_is_bounded(spark, made):
    docs, lab, rows, _ = made
    every, good = ranking.sample(docs, lab)
    kept = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(m.tobytes() for m in every) == sorted(ranking.measures(t).tobytes() for _, t in kept) and good.sum() == sum(i % 7 != 0 for i, _ in kept)
    assert len(ranking.sample(docs, lab, 9)[0]) == 9
    again = ranking.train(docs.repartition(5), lab)
    assert np.array_equal(again.weights, made[3].weights) and again.threshold == made[3].threshold
    two = spark.createDataFrame([(0, 1), (0, 0), (2, 1)], "doc_id long, quality int")
    assert sorted(ranking.sample(docs, two)[1].tolist()) in ([False, True], [False], [True])  # bad if one label says so


def test_pairs_hold_every_document():
    good = np.array([True, False, True, True, False, True, True])
    better, worse = ranking.pairs(good, 3)
    assert good[better].all() and not good[worse].any() and len(better) == 15
    assert set(better) | set(worse) == set(range(7))
    better, worse = ranking.pairs(~good, 3)
    assert not good[better].any() and good[worse].all() and set(better) | set(worse) == set(range(7))


def test_fit_is_at_the_minimum_and_the_threshold_a_quantile():
    rng = np.random.default_rng(1)
    rows, good = rng.normal(size=(300, ranking.WIDTH)), np.arange(300) % 4 != 0
    rows[good, 0] += 1
    model = ranking.fit(rows, good, l2=0.01)
    better, worse = ranking.pairs(good)
    units = rows / rows.std(0)
    apart, w = units[better] - units[worse], model.weights * rows.std(0)
    least = ranking.loss(w, apart, 0.01)
    by_definition = np.mean([np.log1p(np.exp(-d @ w)) for d in apart]) + 0.005 * w @ w
    assert least == pytest.approx(by_definition)
    for k in range(ranking.WIDTH):
        assert min(ranking.loss(w + e * np.eye(ranking.WIDTH)[k], apart, 0.01) for e in (-1e-3, 1e-3)) > least
    assert (model.score(rows) < 0.5).sum() == (~good).sum()


def test_edges(spark, made):
    docs, lab, _, model = made
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "ab CD!! " * 60_000), (4, "ab CD!! " * 60_000), (None, "x ×½ 日本 #1")]
    some = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, predicted int, k string")
    got = sorted(ranking.scored(some, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == 6 and len({r.score for r in got[:3]}) == 1 and got[3].score == got[4].score and all(0 <= r.score <= 1 for r in got)
    assert ranking.scored(some.limit(0), model).count() == 0
    assert {r.score for r in ranking.scored(some, ranking.train(docs, lab.limit(0))).collect()} == {0.5}
    assert {r.score for r in ranking.scored(some, ranking.train(docs, lab.where("quality = 1 AND doc_id % 7 <> 0"))).collect()} == {1.0}
    assert {r.predicted for r in ranking.scored(some, ranking.train(docs, lab.where("quality = 0"))).collect()} == {0}


def test_measures_by_definition():
    text = "Ab ab ab CDe!! #1x\n\nAb ab\nAb ab"
    m = dict(zip(ranking.MEASURES, ranking.measures(text)))
    words = text.split()
    chars = sum(map(len, words))
    assert m["words"] == np.log1p(9) and m["word_length"] == chars / 9 and m["repeats"] == 1 - 4 / 9 and m["echoes"] == 1 / 9
    assert m["capitals"] == pytest.approx(1 / 18) and m["exclaims"] == 2 / chars and m["symbols"] == 1 / chars and m["digits"] == 1 / chars
    assert m["commonest"] == 4 / 9 - 1 / 9 and m["lines_again"] == 1 - 2 / 3 and m["odd_words"] == 1 / 9
