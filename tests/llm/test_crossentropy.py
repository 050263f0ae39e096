"""Scores against dictionaries of counts."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import crossentropy as ce
from strandloom.session import written


def plain(rows, target, n_words):
    """Each text by the counts of all the other texts."""
    toks = [[w.decode() for w in ce.words(t)] for _, t in rows]
    seqs = [["<s>", *t] for t in toks]
    pairs_of = [Counter(zip(s, s[1:])) for s in seqs]
    out = []
    for i, (d, _) in enumerate(rows):
        loss = []
        for keep in (lambda x: True, lambda x: x in target):
            pairs = Counter()
            for j, (e, _) in enumerate(rows):
                if j != i and keep(e):
                    pairs.update(pairs_of[j])
            context, single = Counter(), Counter()
            for (a, b), n in pairs.items():
                context[a] += n
                single[b] += n
            x, total = 0.0, sum(single.values())
            for a, b in zip(seqs[i], seqs[i][1:]):
                p = (single[b] + ce.ADDED) / (total + ce.ADDED * (n_words + 1))
                if context[a]:
                    p = ce.BIGRAM_WEIGHT * pairs[a, b] / context[a] + (1 - ce.BIGRAM_WEIGHT) * p
                x -= math.log(p)
            loss.append(x / max(1, len(seqs[i]) - 1))
        out.append((d, len(seqs[i]) - 1, *loss, loss[0] - loss[1]))
    return out


def test_scores(spark):
    random.seed(6)
    topics = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    rows = [(i, " ".join(random.choices(topics[i % 3] + ["The", "the", "é"], k=random.randint(1, 60)))) for i in range(120)]
    rows += [(150, None), (151, ""), (152, " \t\n"), (153, "once"), (3, rows[3][1]), (154, "a1 a2 " * 1000), (None, "b1 b2"), (None, "c1")]
    target = {i for i in range(0, 120, 3)}
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, block int").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*target, None, 0]], "doc_id long")
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    n_words = ce.vocabulary_size(written(ce.blocks(docs), "blocks"))
    assert n_words == len({w for _, t in rows for w in ce.words(t)})
    want = sorted(plain(rows, target, n_words), key=order)
    for chars in (ce.BLOCK_CHARS, 500):
        got = sorted(map(tuple, ce.scored(docs, ids, chars).collect()), key=order)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-9)
    by_topic = [sum(g[4] for g in got if g[0] is not None and g[0] < 120 and g[0] % 3 == t) for t in range(3)]
    assert by_topic[0] > 0 > max(by_topic[1:])


def test_probabilities_of_all_words_make_one():
    words = ce.mixed(np.array([11, 12, 13, 14, 99], np.uint64))  # the last is in no text
    texts = [[0, 1, 0, 2, 1], [2, 2, 0, 3], [0, 1, 2, 0, 0, 1]]

    def block(texts, targets):
        row = {"doc_ids": list(range(len(texts))), "lens": [len(t) for t in texts], "words": words.view(np.int64), "tokens": ce.packed(np.array([w for t in texts for w in t], np.uint32)), "targets": targets}
        return ce.Block(row, 3)

    def loss(text):
        # as if the text were one of the corpus, so that taking it off leaves the three
        alone, whole = block([text], None), block([*texts, text], [0, 2])
        place = {k: i for i, k in enumerate(zip(whole.bucket.tolist(), whole.keys.tolist()))}
        counts = [c[[place[k] for k in zip(alone.bucket.tolist(), alone.keys.tolist())]] for c in whole.counts()]
        return np.array([x[0] * len(text) for x in ce.losses(alone, counts, (15 + len(text), 11), (4, 2), 4)])

    for context in range(4):
        total = sum(np.exp(loss([context]) - loss([context, w])) for w in range(5))
        assert total == pytest.approx([1, 1])
    assert sum(np.exp(-loss([w])) for w in range(5)) == pytest.approx([1, 1])


def test_tokens_are_packed_and_unpacked():
    for x in ([], [0], [5, 70_000, 2**32 - 1]):
        assert ce.unpacked(ce.packed(np.array(x, np.uint32))).tolist() == x


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ce.scored(docs, docs.select("doc_id")).count() == 0
