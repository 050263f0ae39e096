"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share at
least six positional bytes: that is the guaranteed minimum. A posting list of one position and byte would hold a
256th of all documents, and pairs from it would grow with the square of the table. So postings are keyed by the bytes
at four positions together. The six position sets below are chosen so that any two positions are missing from at
least one of them: whichever two bytes differ, one set is untouched and both fingerprints are in its posting list.
Within a list the shared positional bytes of each pair are tallied, pairs with six or more are retained, and the bits
that differ are counted to verify.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.blocks import cut_hot, forest, in_groups
from strandloom.llm.common import boxed, components, row_key
from strandloom.llm.registry_base import register
from strandloom.session import table, written

MAX_BITS, BYTES, SEED = 2, 8, 42
LEAST_SHARED = BYTES - MAX_BITS
#: Positions of a posting's bytes; every pair of positions is outside at least one set.
POSITION_SETS = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 1, 6, 7), (2, 3, 4, 5))
assert all(any(not set(p) & set(s) for s in POSITION_SETS) for p in combinations(range(BYTES), MAX_BITS))


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles (repeats included); no words: zero."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else [b" ".join(w)]
    n = max(1, len(w) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):  # whole texts, in pieces that bound the memory
        counts += np.unpackbits(h[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: str = "doc_id") -> DataFrame:
    """(``keep``, fp): the fingerprint of the text of every row of ``docs`` as a signed long."""
    k, kind = boxed(docs, keep)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"k": batch["k"], "fp": fps.view(np.int64)})

    return docs.select(k, "text").mapInPandas(run, f"{kind}, fp long").select(F.col("k.k0").alias(keep), "fp")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that keep what the verified pairs connect.

    A posting list answers with a forest of its pairs, so it never yields more rows than it has.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * (BYTES - 1 - p)).bitwiseAND(F.lit(255))

    def key(positions):
        out = F.lit(0).cast("long")
        for p in positions:
            out = out * 256 + byte(p)
        return out

    postings = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("s"), key(s).alias("v")) for k, s in enumerate(POSITION_SETS)])).alias("p")).select("fp", F.col("p.s").alias("s"), F.col("p.v").alias("v"))

    def handle(group: pd.DataFrame) -> pd.DataFrame | None:
        fp = group["fp"].to_numpy()
        own = fp.astype(">i8").view(np.uint8).reshape(-1, BYTES)
        left, right = [], []
        for lo in range(0, len(fp), 256):
            shared = (own[lo : lo + 256, None, :] == own[None, :, :]).sum(axis=2, dtype=np.uint8)  # the tally
            i, j = np.nonzero(np.triu(shared >= LEAST_SHARED, lo + 1))
            close = np.bitwise_count((fp[lo + i] ^ fp[j]).view(np.uint64)) <= MAX_BITS
            left.append(lo + i[close])
            right.append(j[close])
        left, right = np.concatenate(left), np.concatenate(right)
        if not len(left):
            return None
        root = forest(len(fp), left, right)
        own_root = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[root[own_root]], "b": fp[own_root]})

    return in_groups(cut_hot(postings, ["s", "v"], "fp"), ["s", "v", "_i", "_j"], handle, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp2, c): the component of every distinct fingerprint in ``prints`` (fp), named by one of its fingerprints."""
    nodes = prints.select("fp").distinct()
    reach = components(links(nodes))
    return nodes.join(reach, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("fp2"), F.coalesce("component", "fp").alias("c"))


def grouped(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link share the smallest doc_id reachable.

    Equal fingerprints are one node, so copies cost one posting each and are never paired. Blank and null texts have
    fingerprint zero and link like any other. A null doc_id takes part; it is the component's id only if there is no
    other. Repeated rows each get a row. An empty table gives an empty result. Other columns are not read.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    named = firsts.join(classes(prints), F.col("fp") == F.col("fp2"))
    by_fp = named.select("fp2", F.min("first_id").over(Window.partitionBy("c")).alias("component_id"))
    return prints.join(by_fp, F.col("fp") == F.col("fp2")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their group of near copies.

    First is by doc_id, null ids last, then by a hash of the row's doc_id and text: of several rows without an id, or
    of two texts under one id, each stands on its own and leaves only if an earlier row of its group stays. Rows equal
    in doc_id and text are one document and give one row. Blank and null texts are one group. An empty table gives an
    empty result, and columns of any name may be there. Texts are shuffled once, and copies of a row only by its key.
    """
    keyed = docs.select(F.struct("doc_id", row_key("doc_id", "text").alias("key")).alias("k"), "text")
    prints = written(fingerprints(keyed, width, "k"), "fingerprints")
    order = F.min(F.struct(F.col("k.doc_id").isNull(), "k.doc_id", "k.key"))
    of_fp = prints.groupBy("fp").agg(order.alias("first")).join(classes(prints), F.col("fp") == F.col("fp2"))
    keep = of_fp.groupBy("c").agg(F.min("first").alias("first")).select("first.key")
    boxed = docs.select(row_key("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = boxed.join(keep, "key", "left_semi")
    if not prints.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        left = left.groupBy("key").agg(F.first("row").alias("row"))
    return left.select("row.*")


@register("op7_simhash_groups")
def op7_simhash_groups(spark, sf_dir):
    out = grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
