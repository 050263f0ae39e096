"""Language-model scoring by cross-entropy difference.

Two bigram models, of target texts and of all texts, share one vocabulary (every word of the corpus, and one place for
words that are not in it) and one smoothing, so that the difference of their losses on a word speaks of the domain and
not of the models. A document's score is the mean over its words of background loss minus target loss: the higher, the
closer to the target. A text is scored by what the models know without it: its own counts are taken off the models it
is part of, so target texts are held out one by one.

Counts are of the whole corpus and nothing is pruned, so the tables grow with it and none goes to all tasks. Texts are
cut into blocks of a bounded size, each a row. A block asks for the counts of the words and bigrams it holds, once each,
and gets back what the corpus has of them: its own part of the two models. Questions are dealt into buckets by key and
travel as sorted, packed arrays, a row a block and bucket; answers come in the same order and need not repeat the keys.
A bucket holds a bounded number of keys, and of a key at most one entry a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import boxed
from strandloom.llm.registry_base import register
from strandloom.session import table, written

BIGRAM_WEIGHT, ADDED = 0.6, 0.5
#: Characters of a block of texts; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Tokens of the corpus for which there is a bucket: it has at most as many entries of bigrams, and of words.
BUCKET_TOKENS = 1_000_000
#: Key of the place before the first word.
START = np.uint64(0x5EED)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(context + np.uint64(0x9E3779B97F4A7C15)) + word)


def packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers byte by byte, all lowest bytes first: high ones are mostly zero and shrink to nothing."""
    return zstandard.compress(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(bytes(data)), np.uint8)
    return raw.reshape(width, -1).T.copy().view(f"<u{width}").ravel()


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, doc_ids, lens, words, tokens): texts as numbers of the block's own words, which are listed by their keys.

    Blocks follow the partitions of ``docs``, so nothing is shuffled; the result is to be written before it is used."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, lens, own, tokens, held = [], [], {}, [], 0

        def row():
            keys, flat = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)), np.concatenate(tokens)
            # frequent words get small numbers, which pack better
            order = np.argsort(-np.bincount(flat, minlength=len(own)), kind="stable")
            rank = np.empty(len(own), np.uint32)
            rank[order] = np.arange(len(own))
            return pd.DataFrame({"block": [part << 32 | made], "doc_ids": [ids], "lens": [lens], "words": [keys[order].view(np.int64)], "tokens": [packed(rank[flat])]})

        for batch in batches:
            for k, text in zip(batch["k"], batch["text"]):
                if ids and held + len(text or "") > block_chars:
                    yield row()
                    made += 1
                    ids, lens, own, tokens, held = [], [], {}, [], 0
                seq = np.fromiter((own.setdefault(w, len(own)) for w in words(text)), np.uint32)
                ids.append(k["k0"])
                lens.append(len(seq))
                tokens.append(seq)
                held += len(text or "")
        if ids:
            yield row()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(boxed(docs, "doc_id")[0], "text").mapInPandas(run, f"block long, doc_ids array<{kind}>, lens array<int>, words array<long>, tokens binary")


class Block:
    """A block's tokens as arrays: the document, word, context and bigram of each."""

    def __init__(self, row, n_buckets: int):
        self.ids, self.lens = list(row["doc_ids"]), np.asarray(row["lens"], np.int64)
        keys = np.asarray(row["words"], np.int64).view(np.uint64)
        word = keys[unpacked(row["tokens"])]
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.first, self.last = np.zeros(len(word), bool), np.zeros(len(word), bool)
        ends, some = np.cumsum(self.lens), self.lens > 0
        self.first[(ends - self.lens)[some]] = self.last[ends[some] - 1] = True
        self.target = np.zeros(len(self.lens), bool)
        if row["targets"] is not None:
            self.target[np.asarray(row["targets"], np.int64)] = True
        before = np.concatenate(([START], word[:-1])) if len(word) else word
        # keys of the words, then of the bigrams, of 56 bits; the order of the questions is by bucket, then key
        both = np.concatenate((word, pair_key(np.where(self.first, START, before), word))) >> np.uint64(8)
        k, at = np.unique(both, return_inverse=True)
        bucket = (k % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(k), np.int64)
        rank[order] = np.arange(len(k))
        # within a bucket the quotient tells a key
        self.keys, self.bucket = k[order] // np.uint64(n_buckets), bucket[order]
        self.word, self.pair = rank[at[: len(word)]], rank[at[len(word) :]]

    def counts(self) -> list[np.ndarray]:
        """How often each key occurs in the block's texts and its target texts, and ends a text of them."""
        held, n = self.target[self.doc], len(self.keys)
        every = np.concatenate((self.word, self.pair))
        return [np.bincount(every, minlength=n), np.bincount(every[np.tile(held, 2)], minlength=n), np.bincount(self.word[self.last], minlength=n), np.bincount(self.word[self.last & held], minlength=n)]


def own_counts(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each token how often its document has that key."""
    _, back, n = np.unique(doc * (int(at.max()) + 1 if len(at) else 1) + at, return_inverse=True, return_counts=True)
    return n[back]


def losses(one: Block, counts: list[np.ndarray], n_tokens: tuple[int, int], n_texts: tuple[int, int], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean background and target loss in nats of each document, by the models without it. counts: of the corpus, for
    the block's keys as in ``Block.counts``; n_tokens, n_texts: of the corpus and of the target, texts with a word."""
    words_own, pairs_own = own_counts(one.doc, one.word), own_counts(one.doc, one.pair)
    final = np.full(len(one.lens), -1)
    final[one.doc[one.last]] = one.word[one.last]
    back = lambda x: np.concatenate(([0], x[:-1])) if len(x) else x
    size, out = np.maximum(one.lens, 1), []
    for m, part in enumerate((np.ones(len(one.lens), bool), one.target)):
        held = part[one.doc]
        word = counts[m][one.word] - np.where(held, words_own, 0)
        pair = counts[m][one.pair] - np.where(held, pairs_own, 0)
        # a word is a context where it is not the last; before the first word there is one context a text
        open_ = word - counts[2 + m][one.word] + (held & (one.word == final[one.doc]))
        context = np.where(one.first, n_texts[m] - held, back(open_))
        rest = (n_tokens[m] - np.where(part, one.lens, 0))[one.doc]
        p = (word + ADDED) / (rest + ADDED * (n_words + 1))
        p = np.where(context > 0, BIGRAM_WEIGHT * pair / np.maximum(context, 1) + (1 - BIGRAM_WEIGHT) * p, p)
        out.append(np.bincount(one.doc, -np.log(p), len(one.lens)) / size)
    return out[0], out[1]


#: What is counted of a key: as ``Block.counts`` lists it.
COUNTS = ("n", "t", "en", "et")


def question(keys: np.ndarray, counts: list[np.ndarray]) -> dict[str, bytes]:
    """Sorted keys by their steps, and their counts."""
    return {"k": packed(np.diff(keys, prepend=np.uint64(0)), 8)} | {c: packed(x) for c, x in zip(COUNTS, counts)}


def answers(asked: pd.DataFrame) -> pd.DataFrame:
    """What all the blocks of a bucket have together, to each of them in the order of its question."""
    keys = [np.cumsum(unpacked(k, 8), dtype=np.uint64) for k in asked["k"]]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    out = {"block": asked["block"], "bucket": asked["bucket"]}
    for c in COUNTS:
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate([unpacked(x) for x in asked[c]]).astype(np.int64))
        out[c] = [packed(x, 8) for x in np.split(total[at], ends)]
    return pd.DataFrame(out)


def vocabulary_size(encoded: DataFrame) -> int:
    """How many words the corpus has, exactly: what both models share with words that are not in it. A block has each
    of its words once, and tasks combine theirs before the shuffle."""
    return encoded.select(F.explode("words").alias("w")).distinct().count()


def scored(docs: DataFrame, target_ids: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, loss_background, loss_target, score) of whole texts, losses as means over the words.

    ``target_ids`` (doc_id) tells the target texts; null and repeated ids there mean nothing. Null and blank texts have
    no tokens, losses and score 0. Repeated rows count as often as they occur and each is scored without itself alone;
    every row of a target id is a target text. An empty table gives an empty result; other columns are not read.
    """
    encoded = written(blocks(docs, block_chars), "blocks")
    ids = target_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    each = encoded.select("block", F.posexplode(F.arrays_zip("doc_ids", "lens")).alias("pos", "d")).select("block", "pos", "d.doc_ids", "d.lens")
    # ids grow with the corpus, so they are never broadcast
    hits = written(each.join(ids.hint("merge"), F.col("doc_ids") == F.col("_id"), "left_semi").select("block", "pos", "lens"), "targets")
    total = lambda df: tuple(x or 0 for x in df.agg(F.sum("lens"), F.count_if(F.col("lens") > 0)).first())
    (n_all, texts_all), (n_target, texts_target) = total(each), total(hits)
    n_words = vocabulary_size(encoded)
    n_buckets = max(64, -(-n_all // BUCKET_TOKENS))
    targets = hits.groupBy("block").agg(F.collect_list("pos").alias("targets")).withColumnRenamed("block", "_block")
    flagged = encoded.join(targets.hint("merge"), F.col("block") == F.col("_block"), "left").drop("_block")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        one = Block(pdf.iloc[0], n_buckets)
        found, starts = np.unique(one.bucket, return_index=True)
        counts, cuts = one.counts(), [*starts, len(one.keys)]
        rows = [question(one.keys[a:b], [c[a:b] for c in counts]) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame(rows, columns=["k", *COUNTS]).assign(block=pdf["block"].iloc[0], bucket=found)[["block", "bucket", "k", *COUNTS]]

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one, right = Block(left.iloc[0], n_buckets), right.sort_values("bucket")
        counts = [np.concatenate([unpacked(x, 8) for x in right[c]]).astype(np.int64) if len(right) else np.zeros(0, np.int64) for c in COUNTS]
        background, target = losses(one, counts, (n_all, n_target), (texts_all, texts_target), n_words)
        return pd.DataFrame({"doc_id": pd.Series(one.ids, dtype=object), "n_tokens": one.lens, "loss_background": background, "loss_target": target, "score": background - target})

    counted = ", ".join(f"{c} binary" for c in COUNTS)
    asked = flagged.groupBy("block").applyInPandas(ask, f"block long, bucket long, k binary, {counted}")
    known = asked.groupBy("bucket").applyInPandas(answers, f"block long, bucket long, {counted}")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.DoubleType() if c != "n_tokens" else T.LongType()) for c in ("n_tokens", "loss_background", "loss_target", "score"))])
    return flagged.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(answer, schema)


def good_ids(labels: DataFrame) -> DataFrame:
    """The target: documents labelled of good quality and not toxic."""
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")


@register("op8_cross_entropy_difference")
def op8_cross_entropy_difference(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), good_ids(table(spark, sf_dir, "labels")))
