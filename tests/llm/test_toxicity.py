"""Held-out accuracy on made-up documents, sentences found, and edge cases."""

import random
import zlib

import numpy as np
import pytest

from strandloom.llm import toxicity


@pytest.fixture(scope="module")
def made(spark):
    random.seed(12)
    vocab = ["".join(random.choices("aeiourstln", k=random.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        sents = [" ".join(random.choices(vocab, k=random.randint(3, 12))) for _ in range(random.randint(1, 12))]
        bad = i % 5 == 0
        if bad:
            k = random.randrange(len(sents))
            sents[k] += " " + random.choice(["wretchish", "wretchling", "scoundrel", "scoundrels"])
        rows.append((i, ". ".join(sents) + "."))
        labels.append((i, 1, int(bad)))
    labels += [(3, None, None), (None, 1, 1), (5, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, lab, rows, toxicity.train(docs, lab)


def test_held_out_accuracy(spark, made):
    docs, _, rows, model = made
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    fold = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == (i % 5 == 0) for i in fold) / len(fold) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_offending_sentences(made):
    docs, _, rows, model = made
    text = dict(rows)
    for r in toxicity.located(docs, model).collect():
        assert text[r.doc_id][r.start : r.end] == r.sentence and ("wretch" in r.sentence or "scoundrel" in r.sentence)


def test_edges_and_reruns(spark, made):
    docs, lab, _, model = made
    again = toxicity.train(docs.repartition(7), lab)
    assert again.bias == pytest.approx(model.bias) and again.weights == pytest.approx(model.weights)
    rows = [(1, None), (2, ""), (3, " .\n! "), (4, "scoundrel " * 50_000), (4, "scoundrel " * 50_000), (None, "x")]
    some = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, predicted int")
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.scored(some, model).collect()]
    assert len(got) == 6 and [g for g in got if g[0] in (1, 2, 3)] == [(i, 0.0, 0) for i in (1, 2, 3)]
    assert [g[2] for g in got if g[0] == 4] == [1, 1]
    kept = toxicity.accepted(some, model)
    assert kept.columns == some.columns and kept.count() == 4
    assert toxicity.scored(some.limit(0), model).count() == 0
    none = toxicity.train(docs, lab.limit(0))
    assert toxicity.scored(some, none).where("predicted = 1").count() == 0


def test_likelihood_and_gradient_by_definition():
    rng = np.random.default_rng(3)
    docs = [[[int(w) for w in rng.integers(0, 5, rng.integers(0, 4))] for _ in range(rng.integers(0, 4))] for _ in range(12)]
    toxic = [bool(t) for t in rng.integers(0, 2, 12)]
    made = toxicity.Bags.of([(np.array([w for s in d for w in s], np.uint16), np.array([len(s) for s in d], np.uint32), t) for d, t in zip(docs, toxic)])

    def by_definition(theta):
        loss = 0.0
        for d, t in zip(docs, toxic):
            clean = np.prod([1 - 1 / (1 + np.exp(-(theta[-1] + sum(theta[w] for w in s)))) for s in d])
            loss -= np.log(max(1 - clean, 1e-9)) if t else np.log(clean)
        return loss / 12 + 0.05 / 2 * (theta[:-1] ** 2).sum()

    theta = rng.normal(size=6)
    loss, grad = made.likelihood(theta, 0.05)
    assert loss == pytest.approx(by_definition(theta))
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert grad[k] == pytest.approx((by_definition(theta + step) - by_definition(theta - step)) / 2e-6, abs=1e-6)


def test_score_by_definition():
    model = toxicity.Model(-1.0, {"bad": 2.0, "badl*": 0.5, "fine": -1.0, "fine*": 0.25})
    text = "Bad fine. badly! nothing here\n\n...finer bad bad"
    each = [-1 + 2 - 1, -1 + 0.5, -1, -1 + 0.25 + 2]
    p = [1 / (1 + np.exp(-z)) for z in each]
    assert [s for _, _, s in model.sentences(text)] == pytest.approx(p)
    assert model.score(text)[0] == pytest.approx(1 - np.prod([1 - x for x in p]))


def test_sample_is_bounded_and_takes_texts_of_any_length(spark, made):
    docs, lab, rows, _ = made
    every = {r.doc_id: len(r.text) for r in toxicity.sample(docs, lab).collect()}
    assert set(every) == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    some = {r.doc_id: len(r.text) for r in toxicity.sample(docs, lab, max_chars=5000).collect()}
    assert set(some) < set(every) and sum(some.values()) >= 5000 > sum(some.values()) - max(some.values())
    assert toxicity.sample(docs, lab, max_docs=9).count() == 9
