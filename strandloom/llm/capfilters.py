"""Embedding near-duplicates with spherical-cap filters.

A filter is a direction; a vector passes it if their inner product reaches a threshold, that is, if the vector lies in
the cap around the direction. Close vectors share caps. The directions are structured: a random rotation, then a random
product code, one of B short codewords in each of a few blocks of coordinates, so B**blocks filters need only
B * blocks products a vector. List decoding walks the blocks and drops a partial sum as soon as the best remainder
cannot reach the threshold, and so lists all filters a vector passes. Vectors join on filters, and pairs are verified
by their cosine in double precision.

The threshold is what the vector has with its best filter, its home, less SLACK deviations of what a pair at the limit
differs by in an inner product. Two vectors meet in the home of one that the other passes too: a vector is listed in
all its filters, but compared in each only with those at home there, which are few, as homes are dealt over filters in
proportion to the vectors. How many filters a vector passes grows with their logarithm and not with the dimension.

A pair is counted in the least of the filters where it meets. Rows carry their homes and thresholds, so a bucket can
tell in which others it would meet: no pair has to be written down to be counted once, and a bucket answers with a row
per vector, however many pairs it holds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.blocks import BLOCK, cut_hot, forest, in_groups
from strandloom.llm.common import components
from strandloom.llm.registry_base import register
from strandloom.session import table, written

COSINE = 0.98
#: Codes with rotations of their own; a pair is missed only if it meets in none.
CODES = 2
#: Of 1,000 random pairs of cosine 0.9801 none is missed with 2,000 filters a label nor with 400,000, in 64 dimensions
#: nor in 768, at 9 to 22 filters a vector. In units of the deviation, sqrt(2 - 2 * cosine) / sqrt(dimension).
SLACK = 1.5
#: Filters for each vector of the largest label: buckets keep their size as tables grow.
FILTERS_A_VECTOR, SEED = 0.4, 20_24


class ProductCode:
    """One rotation and its product code for vectors of ``dim`` coordinates."""

    def __init__(self, dim: int, n_filters: int, seed: int):
        rng = np.random.default_rng([SEED, seed, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks = max(1, min(dim, 2 if n_filters <= 1 << 20 else 3 if n_filters <= 1 << 30 else 4))
        self.size = max(2, math.ceil(n_filters ** (1 / self.blocks)))
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.slack = SLACK * math.sqrt(2 * (1 - COSINE) / dim)
        # codewords have the length their block has in a random unit vector, so every filter is a unit vector
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            w = rng.standard_normal((self.size, b - a))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt((b - a) / dim))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter) of all filters the unit vectors x pass; and of each vector its home and its threshold."""
        y = x @ self.rotation
        parts = [y[:, a:b] @ w.T for (a, b), w in zip(zip(self.cuts, self.cuts[1:]), self.words)]
        home, rest, beyond = np.zeros(len(x), np.int64), np.zeros(len(x)), []
        for p in parts:
            home = home * self.size + p.argmax(axis=1)
        for p in parts[::-1]:
            beyond.append(rest.copy())
            rest += p.max(axis=1)
        least = rest - self.slack
        rows, sums, codes = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for p, b in zip(parts, beyond[::-1]):
            total = sums[:, None] + p[rows]
            r, c = np.nonzero(total + (b - least)[rows][:, None] >= 0)
            rows, sums, codes = rows[r], total[r, c], codes[r] * self.size + c
        return rows, codes, home, least

    def passes(self, x: np.ndarray, filters: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether each vector passes the filter beside it."""
        y, total = x @ self.rotation, np.zeros(len(x))
        for k in range(self.blocks - 1, -1, -1):
            total += np.einsum("ij,ij->i", y[:, self.cuts[k] : self.cuts[k + 1]], self.words[k][filters % self.size])
            filters = filters // self.size
        return total >= least


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def components_of(vectors: DataFrame) -> Column:
    """The embedding as floats if it is stored so, which doubles hold exactly later; else as doubles."""
    return F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (label, embedding) with cls (smallest vec_id) and copies. Null labels, null or empty vectors, ones
    with null or non-finite components and zero vectors take no part."""
    v = vectors.select("vec_id", "label", components_of(vectors).alias("e"))
    fine = F.col("label").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    return v.where(fine).groupBy("label", "e").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"))


def buckets(classes: DataFrame, n_filters: int) -> DataFrame:
    """(label, dim, filter, cls, copies, e, homes, least): every class once for each filter its vector passes."""

    def run(batches):
        codes: dict[tuple[int, int], ProductCode] = {}
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                for dim, same in part.groupby(part["e"].map(len)):
                    x = unit(same["e"].tolist())
                    found = []
                    for k in range(CODES):
                        if (dim, k) not in codes:
                            codes[dim, k] = ProductCode(dim, n_filters, k)
                        found.append(codes[dim, k].decode(x))
                    rows = np.concatenate([f[0] for f in found])
                    homes, least = np.stack([f[2] * CODES + k for k, f in enumerate(found)], axis=1), np.stack([f[3] for f in found], axis=1)
                    out = same.iloc[rows][["label", "cls", "copies", "e"]].reset_index(drop=True)
                    out["dim"], out["filter"] = dim, np.concatenate([f[1] * CODES + k for k, f in enumerate(found)])
                    out["homes"], out["least"] = list(homes[rows]), list(least[rows])
                    yield out[["label", "dim", "filter", "cls", "copies", "e", "homes", "least"]]

    kinds = dict(classes.dtypes)
    return classes.mapInPandas(run, f"label {kinds['label']}, dim int, filter long, cls {kinds['cls']}, copies long, e {kinds['e']}, homes array<long>, least array<double>")


def verifier(n_filters: int):
    """What ``in_groups`` does with one bucket, or pair of blocks of it: per class the copies it links with here, and a
    link that connects it."""
    codes: dict[tuple[int, int], ProductCode] = {}

    def verify(group: pd.DataFrame) -> pd.DataFrame | None:
        here, homes = int(group["filter"].iloc[0]), np.array(group["homes"].tolist())
        at_home = (homes == here).any(axis=1)
        own = np.flatnonzero(at_home)
        if not len(own):
            return None
        x = unit(group["e"].tolist())
        blocks, first, second = group["_b"].to_numpy(), group["_i"].iloc[0], group["_j"].iloc[0]
        left, right = [], []
        for lo in range(0, len(own), 512):
            i, j = np.nonzero(x[own[lo : lo + 512]] @ x.T >= COSINE - 1e-9)
            i = own[lo + i]
            new = (i != j) & (~at_home[j] | (i < j)) & ((first == second) | (blocks[i] != blocks[j]))
            left.append(i[new])
            right.append(j[new])
        i, j = np.concatenate(left), np.concatenate(right)
        i, j = i[(c := np.einsum("ij,ij->i", x[i], x[j]) >= COSINE)], j[c]
        if not len(i):
            return None
        # where else the two meet: in the home of one that the other passes
        least, dim, earlier = np.array(group["least"].tolist()), x.shape[1], np.zeros(len(i), bool)
        for k in range(CODES):
            if (dim, k) not in codes:
                codes[dim, k] = ProductCode(dim, n_filters, k)
            for a, b in ((i, j), (j, i)):
                there = homes[a, k]
                rows = np.flatnonzero((there < here) & ~earlier)
                earlier[rows] = codes[dim, k].passes(x[b[rows]], there[rows] // CODES, least[b[rows], k])
        i, j = i[~earlier], j[~earlier]
        if not len(i):
            return None
        copies, cls = group["copies"].to_numpy(), group["cls"].to_numpy()
        n = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        root = forest(len(x), i, j)
        some = np.flatnonzero(n)
        return pd.DataFrame({"cls": cls[some], "n": n[some].astype(np.int64), "to": cls[root[some]]})

    return verify


def linked(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows compare only within a label and a length. Equal vectors of a label are one class with copies, which link
    with each other. Rows repeated under one vec_id count as vectors of their own. Vectors that take no part have no
    links and are their own component. An empty table gives an empty result; other columns are not read.
    """
    classes = written(usable(vectors), "classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n_filters = max(16, math.ceil(largest * FILTERS_A_VECTOR))
    kinds = dict(classes.dtypes)
    # many small tasks: decoding is the heavy part
    spread = classes.repartition(max(8, vectors.sparkSession.sparkContext.defaultParallelism * 2), "cls")
    keys = ["label", "dim", "filter"]
    groups = cut_hot(buckets(spread, n_filters), keys, "cls", block)
    found = written(in_groups(groups, [*keys, "_i", "_j"], verifier(n_filters), f"cls {kinds['cls']}, n long, to {kinds['cls']}"), "links")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    reach = components(found.where("cls <> to").select(F.col("cls").alias("a"), F.col("to").alias("b")))
    per_class = classes.join(counts.withColumnRenamed("cls", "_c"), F.col("cls") == F.col("_c"), "left").join(reach, F.col("cls") == F.col("node"), "left")
    per_class = per_class.select(F.col("label").alias("_label"), F.col("e").alias("_e"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    rows = vectors.select("vec_id", "label", components_of(vectors).alias("e"))
    out = rows.join(per_class, (F.col("label") == F.col("_label")) & (F.col("e") == F.col("_e")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


CAPS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(id, c) AS (SELECT DISTINCT a, a FROM p UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.c, vec_id) AS component_id, coalesce(m.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.id = vec_id"""


@register("op6_cap_filters", CAPS_SQL)
def op6_cap_filters(spark, sf_dir):
    return linked(table(spark, sf_dir, "embeddings"))
