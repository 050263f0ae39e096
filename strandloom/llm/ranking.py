"""Quality by Bradley-Terry ranking: documents are compared in pairs and a score explains who is preferred.

A document labelled good is preferred to one labelled bad. A document's worth is a weighted sum of what its text
measures, and the chance that one is preferred to another is the logistic of the difference of their worths, so the
weights are fitted by logistic loss on differences of measures; what both of a pair share has no say. Worths have no
natural zero: the threshold is the quantile of the sample's worths below which as many lie as are labelled bad.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import boxed
from strandloom.llm.registry_base import register
from strandloom.session import table

#: The labelled sample for fitting: at most so many documents, by a hash of the id.
MAX_TRAIN_DOCS = 20_000
#: How many of the other label each document of the commoner label meets.
RIVALS = 8
FOLDS, HELD_OUT, CUTOFF = 3, 1, 0.5
#: Weight decay of the fit, in units of a pair.
L2 = 1e-4

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
PLAIN = frozenset(".,;:'\"?()-–—’«»¿¡")
MEASURES = ("words", "word_length", "spread", "capitals", "digits", "symbols", "exclaims", "odd_words", "repeats", "echoes", "commonest", "lines_again", "line_length")
WIDTH = 2 * len(MEASURES)


def measures(text: str | None) -> np.ndarray:
    """What a whole text measures: each of MEASURES, then the square roots, which tell small shares apart.

    Null is read as empty; a text without words measures zero throughout.
    """
    words = WORD(text or "")
    n = len(words)
    if not n:
        return np.zeros(WIDTH)
    counts = Counter(words)
    letters = capitals = digits = symbols = exclaims = odd = 0
    for w, c in counts.items():
        if w.isalpha():
            letters += c * len(w)
            if not w[1:].islower():
                capitals += c * sum(map(str.isupper, w[1:]))
            continue
        own = sum(map(str.isalpha, w))
        letters += c * own
        odd += c * (2 * own < len(w))
        for x in w:
            if x.isupper():
                capitals += c
            elif x.isdigit():
                digits += c
            elif x == "!":
                exclaims += c
            elif not x.isalpha() and x not in PLAIN:
                symbols += c
        capitals -= c * w[0].isupper()
    sizes, times = np.array([len(w) for w in counts], float), np.array(list(counts.values()), float)
    chars = float(sizes @ times)
    mean = chars / n
    lines = [s for s in text.split("\n") if s.strip()]
    out = np.array([
        np.log1p(n), mean, np.sqrt(max((sizes - mean) ** 2 @ times / n, 0.0)), capitals / max(letters, 1), digits / chars, symbols / chars, exclaims / chars, odd / n,
        1 - len(counts) / n, sum(map(eq, words, words[1:])) / n, (times.max() - 1) / n, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(chars / max(len(lines), 1)),
    ])
    return np.concatenate([out, np.sqrt(out)])


@dataclass
class Model:
    mean: np.ndarray
    weights: np.ndarray  # of differences in measures
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, a half at the threshold."""
        return 1 / (1 + np.exp(-np.clip((rows - self.mean) @ self.weights - self.threshold, -700, 700)))


def held_out(doc_id: Column) -> Column:
    """Fold of a document, from its id alone; null ids are in no training fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns as k0, k1, ... of a struct ``k``, and ``m``, the measures of the whole text as packed doubles."""
    k, kind = boxed(docs, *keep)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "m": [measures(t).tobytes() for t in batch["text_"]]})

    return docs.select(k, F.col("text").alias("text_")).mapInPandas(run, f"{kind}, m binary")


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of a bounded sample of labelled documents outside the held-out fold, in hash order.

    A document with several labels is good only if all say so; null labels are none; of rows repeated under one id the
    one whose measures come first is used. The driver gets ``max_docs`` rows of WIDTH numbers at most.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_quality")
    rows = measured(texts, ["doc_id", "_quality"]).groupBy("k.k0").agg(F.min(F.struct("m", "k.k1")).alias("x")).orderBy(F.xxhash64("k0"), "k0").select("x.m", "x.k1").collect()
    return np.array([np.frombuffer(r.m) for r in rows]).reshape(len(rows), WIDTH), np.array([r.k1 > 0 for r in rows], bool)


def pairs(good: np.ndarray, rivals: int = RIVALS) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other): row numbers. Every row of the commoner label meets ``rivals`` rows of the other in turn, so
    every document is in some pair and the number of pairs is linear in the sample."""
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(yes) or not len(no):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    many, few = (yes, no) if len(yes) >= len(no) else (no, yes)
    left, right = np.repeat(many, rivals), few[np.arange(len(many) * rivals) % len(few)]
    return (left, right) if many is yes else (right, left)


def loss(weights: np.ndarray, apart: np.ndarray, l2: float) -> float:
    """Mean logistic loss of preferences on differences of measures."""
    return float(np.logaddexp(0, -(apart @ weights)).mean() + l2 / 2 * weights @ weights)


def fit(rows: np.ndarray, good: np.ndarray, steps: int = 50, l2: float = L2) -> Model:
    """Newton steps on the pairs' logistic loss, halved until the loss falls; no random numbers, so reruns agree.

    Without a document labelled bad all score 1, without one labelled good 0, and without any a half.
    """
    better, worse = pairs(good)
    if not len(better):
        sure = 0.0 if not len(good) else -700.0 if good.all() else 700.0
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), sure)
    mean, scale = rows.mean(0), rows.std(0)
    scale[scale < 1e-12] = 1.0
    units = (rows - mean) / scale
    apart = units[better] - units[worse]
    w, now = np.zeros(WIDTH), loss(np.zeros(WIDTH), apart, l2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(apart @ w, -700, 700)))
        grad = -(p @ apart) / len(apart) + l2 * w
        hess = (apart * (p * (1 - p))[:, None]).T @ apart / len(apart) + l2 * np.eye(WIDTH)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-6 and (then := loss(w - size * step, apart, l2)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-10:
            break
        w, now = w - size * step, then
    worth = np.sort(units @ w)
    k = int((~good).sum())
    return Model(mean, w / scale, float((worth[k - 1] + worth[k]) / 2))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*sample(docs, labels))


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if not given), score and predicted of whole texts.

    Rows are judged each on its own text: repeated rows score alike, null and empty texts score as a text without words,
    null ids are handed on, other columns are not read. An empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    k, kind = boxed(docs, *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = np.array([measures(t) for t in batch["text_"]]).reshape(len(batch), WIDTH)
            score = shared.value.score(rows)
            yield pd.DataFrame({"k": batch["k"], "score": score, "predicted": (score >= CUTOFF).astype("int32")})

    out = docs.select(k, F.col("text").alias("text_")).mapInPandas(run, f"{kind}, score double, predicted int")
    return out.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")


@register("op11_pairwise_quality")
def op11_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
