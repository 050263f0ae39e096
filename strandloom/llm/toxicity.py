"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences and only the bag has a label. A sentence's score is the logistic of its words'
weights; a document is clean only if all its sentences are, so its score is 1 - prod(1 - sentence score). Fitting that
likelihood to document labels makes the sentences that explain a label stand out, and the model then locates them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import boxed
from strandloom.llm.registry_base import register
from strandloom.session import table, written

#: The labelled sample for fitting: at most so many documents, and no more once they hold so many characters. What
#: counts is a document's place in a hash order: none is passed over for its length.
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 10_000, 60_000_000
#: Features of the model: at most so many, each in so many sample documents.
MAX_WORDS, LEAST_DOCS = 4_000, 4
FOLDS, HELD_OUT, CUTOFF = 4, 2, 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+").findall
#: Lengths of word beginnings that are features beside whole words: inflected forms share them.
BEGINNINGS = (4, 5, 6)
#: Words whose weight a task remembers; beyond that it starts over.
MEMO_MAX = 100_000


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]  # of words and of beginnings, which end in *
    memo: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO_MAX:
                self.memo.clear()
            got = self.memo[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence with a word."""
        out = []
        for m in SENTENCE.finditer(text or ""):
            found = set(WORD(m[0].lower()))
            if found:
                z = self.bias + math.fsum(map(self.weight, found))
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-z)) if z > -700 else 0.0))
        return out

    def score(self, text: str | None) -> tuple[float, int, int, int]:
        """Noisy-or of the sentences; how many reach a half; where the worst one lies (-1, -1 without sentences)."""
        sents = self.sentences(text)
        if not sents:
            return 0.0, 0, -1, -1
        p = np.array([s for _, _, s in sents])
        worst = sents[int(p.argmax())]
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), int((p >= 0.5).sum()), worst[0], worst[1]


def held_out(doc_id: Column) -> Column:
    """Fold of a document, from its id alone; null ids are in no training fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """(doc_id, text, toxic): a bounded sample of labelled documents outside the held-out fold, by a hash of the id.

    Several labels of a document count as toxic if one does; null labels are none, and null texts are not taken. Whole
    texts in hash order, until there are ``max_docs`` or they hold ``max_chars`` characters. At most ``max_docs`` ids
    are broadcast, and as many lengths are summed up; of rows repeated under one id one is used.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    texts = written(texts.groupBy("doc_id").agg(F.min(F.struct("text", "_toxic")).alias("x")).select("doc_id", "x.text", (F.col("x._toxic") > 0).alias("toxic")), "toxic-sample")
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    inside = texts.select(F.col("doc_id").alias("_id"), F.coalesce(upto, F.lit(0)).alias("before")).where(F.col("before") < max_chars).select("_id")
    return texts.join(F.broadcast(inside), F.col("doc_id") == F.col("_id"), "left_semi")


def screened(texts: DataFrame) -> list[str]:
    """The features whose share of toxic documents is furthest from the overall share, in standard errors."""

    def count(batches):
        for batch in batches:
            n, bad = Counter(), Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found = {f for w in set(WORD(text.lower())) for f in features(w)}
                n.update(found)
                if toxic:
                    bad.update(found)
            yield pd.DataFrame({"feature": list(n), "n": list(n.values()), "bad": [bad[f] for f in n]})

    rate = texts.agg(F.avg(F.col("toxic").cast("int"))).first()[0] or 0.0
    counts = texts.select("text", "toxic").mapInPandas(count, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= LEAST_DOCS)
    lift = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt("n")
    return [r[0] for r in counts.orderBy(lift.desc(), "feature").limit(MAX_WORDS).select("feature").collect()]


def bags(text: str, vocab: dict[str, int]) -> list[list[int]]:
    """The numbers of the known features of each sentence with a word."""
    return [[vocab[f] for w in sorted(set(found)) for f in features(w) if f in vocab] for s in SENTENCE.findall(text) if (found := WORD(s.lower()))]


@dataclass
class Bags:
    """The sample as arrays: the features in order, the sentence of each, and the document of each sentence."""

    word: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray, bool]]) -> Bags:
        """rows: of each document its features in a row, how many each sentence has, and its label."""
        sizes = [n for _, n, _ in rows]
        per = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        word = np.concatenate([w for w, _, _ in rows]) if rows else np.zeros(0, np.int64)
        return cls(word, np.repeat(np.arange(len(per)), per), np.repeat(np.arange(len(rows)), [len(n) for n in sizes]), np.array([t for _, _, t in rows], bool))

    def likelihood(self, theta: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood of the labels under noisy-or, and its gradient; theta ends with the bias."""
        n, n_sents = len(self.toxic), len(self.document)
        z = np.bincount(self.sentence, theta[self.word], n_sents) + theta[-1]
        s = 1 / (1 + np.exp(-z))
        log_clean = -np.bincount(self.document, np.logaddexp(0, z), n)  # of prod(1 - score)
        clean = np.exp(log_clean)
        loss = -np.where(self.toxic, np.log(np.maximum(1 - clean, 1e-9)), log_clean).sum() / n + l2 / 2 * (theta[:-1] ** 2).sum()
        g = s * np.where(self.toxic, -clean / np.maximum(1 - clean, 1e-9), 1.0)[self.document]
        grad = np.append(np.bincount(self.word, g[self.sentence], len(theta) - 1) / n + l2 * theta[:-1], g.sum() / n)
        return float(loss), grad


def fit(bags: Bags, names: list[str], steps: int = 250, rate: float = 0.2, l2: float = 2e-5) -> Model:
    """Maximise the noisy-or likelihood by full-batch Adam from zero weights: no random numbers, so reruns agree."""
    y = bags.toxic
    if not len(y) or y.all() or not y.any():
        return Model(0.0 if len(y) and y.all() else -12.0, {})
    theta = np.append(np.zeros(len(names)), -5.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, grad = bags.likelihood(theta, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(theta[-1]), dict(zip(names, theta[:-1].tolist())))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the sample. Texts stay on the executors; the driver gets the numbers of the features that the model has,
    two bytes each, of a sample that is bounded in documents and characters."""
    texts = written(sample(docs, labels), "toxic-sample")
    names = screened(texts)
    vocab = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def number(batches):
        for batch in batches:
            found = [bags(t, vocab.value) for t in batch["text"]]
            flat = [np.fromiter(chain.from_iterable(b), np.uint16).tobytes() for b in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "flat": flat, "per": [np.fromiter(map(len, b), np.uint32).tobytes() for b in found]})

    rows = texts.mapInPandas(number, f"doc_id {dict(texts.dtypes)['doc_id']}, toxic boolean, flat binary, per binary").orderBy("doc_id").toLocalIterator()
    return fit(Bags.of([(np.frombuffer(r.flat, np.uint16), np.frombuffer(r.per, np.uint32), r.toxic) for r in rows]), names)


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if not given), score, predicted, n_offending, worst_start, worst_end of whole texts.

    Null and blank texts have no sentence and score 0. Rows are independent: repeated rows score alike, an empty table
    gives an empty result. The model has at most MAX_WORDS words and goes to tasks as a broadcast variable.
    """
    keep = keep or ["doc_id"]
    k, kind = boxed(docs, *keep)
    schema = kind + ", score double, predicted int, n_offending int, worst_start int, worst_end int"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            rows = [m.score(t) for t in batch["text_"]]
            out = pd.DataFrame({"k": batch["k"]})
            for i, name in enumerate(("score", "n_offending", "worst_start", "worst_end")):
                out[name] = [r[i] for r in rows]
            out["predicted"] = (out["score"] >= CUTOFF).astype("int32")
            yield out[["k", "score", "predicted", "n_offending", "worst_start", "worst_end"]]
        m.memo.clear()

    out = docs.select(k, F.col("text").alias("text_")).mapInPandas(run, schema)
    return out.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(keep)], *out.columns[1:])


def located(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score): the offending sentences, offsets in code points.

    Null and empty texts have none. Repeated rows each give theirs, with the doc_id they have, null too; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            rows = [(k, a, b, t[a:b], s) for k, t in zip(batch["k"], batch["text"]) if t for a, b, s in m.sentences(t) if s >= least]
            yield pd.DataFrame(rows, columns=["k", "start", "end", "sentence", "score"])

    k, kind = boxed(docs, "doc_id")
    return docs.select(k, "text").mapInPandas(run, f"{kind}, start int, end int, sentence string, score double").select(F.col("k.k0").alias("doc_id"), "start", "end", "sentence", "score")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic.

    Null and blank texts score 0 and stay. Rows are judged each on its own text, so null or repeated doc_ids and
    columns of any name make no difference; an empty table gives an empty result. Only texts go to Python and only
    scores come back; the rows wait in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in texts:
            yield pd.Series([m.score(t)[0] for t in batch])
        m.memo.clear()

    return docs.where(score("text") < CUTOFF)


@register("op4_toxicity_mil")
def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_offending", "worst_start", "worst_end")
