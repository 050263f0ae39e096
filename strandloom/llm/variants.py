"""Spelling variants: words one edit apart, found through a positional q-gram inverted index with a count filter.

A word of L letters, padded at both ends, has L + 2 trigrams with their positions. An edit destroys three of the longer
word's at most, so words one edit apart share as many as the longer has letters, less one, at positions that differ by
their lengths at most. Words that share so many share one of their four rarest, in an order that all words agree on;
so a word is posted under those only, by trigram, length and position, and meets the words it might be near in one of
these buckets. There the postings of all its trigrams that are within the limits of length and position are merged on a
heap, shortest first; what stays above the bound is verified letter by letter. A pair comes from the first bucket that
both are in.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.blocks import cut_hot
from strandloom.llm.registry_base import register
from strandloom.session import discard, table, written

#: A word has so many letters and occurrences at least; a form has so many times the occurrences of its variant.
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: One in so many runs of a document loses a letter.
SLIPS = 97
#: Letters a gram, and the rarest grams that words one edit apart must share one of: those an edit can destroy, and one.
Q = 3
RAREST = Q + 1
#: Words a bucket holds before it is cut into pairs of blocks, and distinct words a task counts before handing them on.
BLOCK, HELD = 4_096, 300_000

#: Runs in Latin-1, where every letter of the alphabet is one byte; what Latin-1 does not have becomes a question mark.
RUN = re.compile(rb"[a-z\xC0-\xFF]+").findall
PAD = b"\0" * (Q - 1)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs, one in SLIPS of a document's without one of its letters, with their occurrences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def handed_on() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())})
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                start = zlib.crc32(f"{doc_id}:".encode())
                for w, n in Counter(RUN(text.encode("latin-1", "replace").lower())).items():
                    if len(w) >= LEAST_LETTERS:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % SLIPS == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                        total[w] += n
                if len(total) > HELD:
                    yield handed_on()
        if total:
            yield handed_on()

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = read.mapInPandas(run, "word string, n long").where(F.length("word") >= LEAST_LETTERS)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which word, at which position, and the gram as a number of three bytes, for all grams of all words."""
    sizes = np.array([len(w) + Q - 1 for w in words], np.int64)
    b = np.frombuffer(b"".join([PAD + w + PAD for w in words]) + PAD, np.uint8).astype(np.int32)
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = at + np.repeat(np.cumsum(sizes + Q - 1) - (sizes + Q - 1), sizes)
    return word, at, b[place] << 16 | b[place + 1] << 8 | b[place + 2]


def gram_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams and in how many places words have each, for the driver: letters are 90 and padding one, so there are fewer
    than 91 ** 3 grams however many words there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            g, n = np.unique(grams([w.encode("latin-1") for w in batch["word"]])[2], return_counts=True)
            yield pd.DataFrame({"gram": g, "n": n})

    rows = words.select("word").mapInPandas(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    return rows["gram"].to_numpy(), rows["n"].to_numpy()


def postings(words: DataFrame) -> DataFrame:
    """(gram, len, pos, longer, word, n, rarest): each word under its rarest grams, as one of ``len`` letters, and where
    words of a letter less have such a gram, as a longer one. ``rarest`` are these grams and positions, in order."""
    shared = words.sparkSession.sparkContext.broadcast(gram_counts(words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, often = shared.value
        for batch in batches:
            own = [w.encode("latin-1") for w in batch["word"]]
            if not own:
                continue
            word, at, gram = grams(own)
            order = np.lexsort((at, gram, often[np.searchsorted(known, gram)], word))
            word, at, gram = word[order], at[order], gram[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rank = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
            last = gram[first + RAREST - 1]  # a gram that occurs twice is posted at both places
            few = (rank < RAREST) | (gram == last[word])
            # grams equal to the last one follow it without a gap, as they are sorted by gram
            word, at, gram = word[few], at[few], gram[few]
            ends = np.cumsum(np.bincount(word, minlength=len(own)))
            pairs = np.column_stack([gram, at]).astype(np.int32)
            rarest = [pairs[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)]
            size = np.array([len(w) for w in own])[word]
            longer = size > LEAST_LETTERS
            back = longer & (at > 0)
            rows = np.concatenate([word, word[longer], word[back]])
            yield pd.DataFrame({
                "gram": np.concatenate([gram, gram[longer], gram[back]]), "len": np.concatenate([size, size[longer] - 1, size[back] - 1]), "pos": np.concatenate([at, at[longer], at[back] - 1]), "longer": np.arange(len(rows)) >= len(word),
                "word": batch["word"].to_numpy()[rows], "n": batch["n"].to_numpy()[rows], "rarest": np.array(rarest, object)[rows],
            })

    return words.mapInPandas(run, "gram int, len int, pos int, longer boolean, word string, n long, rarest binary")


def merged(lists: list[list[int]], least: int) -> list[int]:
    """The numbers that are in ``least`` of the ascending lists, or more. One that is in so many is in one of the
    shortest, so only these are merged on a heap; in the ``least - 1`` longest it is looked up."""
    if len(lists) < least:
        return []
    lists.sort(key=len)
    cut = len(lists) - least + 1
    out = []
    for k, same in groupby(heapq.merge(*lists[:cut])):
        n = sum(1 for _ in same)
        for i, x in enumerate(lists[cut:]):
            if n >= least or n + len(lists) - cut - i < least:
                break
            at = bisect_left(x, k)
            n += at < len(x) and x[at] == k
        if n >= least:
            out.append(k)
    return out


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether b differs from a by exactly one replaced letter, or is a with one more letter."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


def first_shared(a: bytes, b: bytes, longer: bool) -> tuple[int, int] | None:
    """The first of a's rarest grams, with its position there, that b has among its own within the position limit."""
    there = np.frombuffer(b, np.int32).tolist()
    there = set(zip(there[::2], there[1::2]))
    mine = iter(np.frombuffer(a, np.int32).tolist())
    return next(((g, p) for g, p in zip(mine, mine) if (g, p) in there or longer and (g, p + 1) in there), None)


def near_in_bucket(gram: int, pos: int, rows: list[tuple], split: bool) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n) of a bucket's pairs that no bucket before this one has. rows: (longer, word, n,
    rarest, block); with ``split``, only pairs of different blocks, as the others are met elsewhere."""
    homes = [(w.encode("latin-1"), w, n, rarest, block) for longer, w, n, rarest, block in rows if not longer]
    if not homes or len(rows) < 2:
        return
    size = len(homes[0][0])
    index: list[dict[bytes, list[int]]] = [{} for _ in range(size + Q - 1)]

    def pairs(own: bytes, w: str, n: int, rarest: bytes, block: int, lists: list[list[int]], least: int, longer: bool):
        for k in merged(lists, least):
            there, w2, n2, rarest2, block2 = homes[k]
            if (not split or block != block2) and one_apart(there, own) and first_shared(rarest2, rarest, longer) == (gram, pos):
                yield w2, n2, w, n

    for k, (own, w, n, rarest, block) in enumerate(homes):
        padded = PAD + own + PAD
        cut = [padded[i : i + Q] for i in range(size + Q - 1)]
        yield from pairs(own, w, n, rarest, block, [x for g, at in zip(cut, index) if (x := at.get(g))], size - 1, False)
        for g, at in zip(cut, index):
            at.setdefault(g, []).append(k)
    met = set()
    for longer, w, n, rarest, block in rows:
        if longer and w not in met:
            met.add(w)
            own = w.encode("latin-1")
            padded = PAD + own + PAD
            cut = [padded[i : i + Q] for i in range(size + Q)]
            lists = [x for g, at in zip(cut, index) if (x := at.get(g))] + [x for g, at in zip(cut[1:], index) if (x := at.get(g))]
            yield from pairs(own, w, n, rarest, block, lists, size, True)


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, both ways, once. A bucket over ``block`` words is cut
    into pairs of blocks, so no group is larger than two blocks and no pair is missed."""
    posted = written(postings(words), "postings")
    keys = ["gram", "len", "pos", "_i", "_j"]
    rows = cut_hot(posted, keys[:3], "word", block).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None

        def pairs() -> Iterator[tuple[str, str, int]]:
            if len(held) > 1:
                gram, _, pos, i, j = at
                for w, n, w2, n2 in near_in_bucket(gram, pos, held, i != j):
                    yield w, w2, n2
                    yield w2, w, n

        def frame(found: list) -> pd.DataFrame:
            return pd.DataFrame(found, columns=["word", "near", "near_n"])

        for batch in batches:
            found: list = []
            for key, row in zip(zip(*[batch[k].tolist() for k in keys]), zip(*[batch[c].tolist() for c in ("longer", "word", "n", "rarest", "_b")])):
                if key != at:
                    found += pairs()
                    held, at = [], key
                held.append(row)
            if found:
                yield frame(found)
        if found := list(pairs()):
            yield frame(found)

    return rows.mapInPandas(run, "word string, near string, near_n long")


def rooted(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form), following forms to the last. A form has twice the occurrences, so ways are short
    and without rings; each round doubles the steps taken and is written out."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if then.where("moved").isEmpty():
            return now
        discard(now)
        now = then.select("word", "root")


def grouped(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts, and of which commoner word each is a variant.

    Null texts have no words, null ids are read as '', and rows repeated count as often as they are there; other columns
    are not read. Among near words equally common the smallest in code-point order is the form. An empty table, or one
    without words, gives an empty result.
    """
    words = written(counted(docs), "words")
    best = near(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    out = written(out, "forms")
    roots = rooted(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@register("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
