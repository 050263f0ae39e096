"""Compare all rows of a bucket with each other without ever holding a large bucket in one task.

A bucket of up to BLOCK rows is one group. A larger one is cut into blocks by a hash of the row id, and every pair of
blocks is a group of its own: each row goes to as many groups as there are blocks, and no pair is missed. Groups are
hash-partitioned, sorted, and handed to a function as numpy arrays, several groups to an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import written

BLOCK = 1024


def cut_hot(rows: DataFrame, keys: list[str], id_col: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with columns _i <= _j (the pair of blocks) and _b (the row's block). Only the sizes of the buckets over
    ``block`` rows are gathered; they are broadcast after counting that they are few, so that the rows themselves are
    shuffled once, by ``in_groups``."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    large = written(large.select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / block).cast("int").alias("_m")), "large-buckets")
    n = large.count()
    if not n:
        return rows.withColumns({c: F.lit(0) for c in ("_b", "_i", "_j")})
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    joined = rows.join(F.broadcast(large) if n <= 100_000 else large, on, "left").withColumn("_m", F.coalesce("_m", F.lit(1))).drop(*[f"_{k}" for k in keys])
    own = F.pmod(F.xxhash64(id_col), F.col("_m")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda k: F.struct(F.least(k, F.col("_b")).alias("i"), F.greatest(k, F.col("_b")).alias("j")))
    return joined.withColumn("_b", own).select("*", F.explode(pairs).alias("_p")).select(*rows.columns, "_b", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"))


def in_groups(rows: DataFrame, keys: list[str], handle: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply ``handle`` to the rows of each group. Rows are shuffled once by the keys and sorted; a group that goes
    over the end of an Arrow batch waits for the next one, so a task holds a batch and a group at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            ends = bounds(batch)
            whole, rest = ends[-2], batch.iloc[ends[-2] :]
            yield from groups(batch.iloc[:whole], ends[:-1])
        if rest is not None and len(rest):
            yield from groups(rest, [0, len(rest)])

    def bounds(batch: pd.DataFrame) -> list[int]:
        if not len(batch):
            return [0, 0]
        new = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return [0, *np.flatnonzero(new).tolist(), len(batch)]

    def groups(batch: pd.DataFrame, ends: list[int]) -> Iterator[pd.DataFrame]:
        found = [out for a, b in zip(ends, ends[1:]) if b - a > 1 and (out := handle(batch.iloc[a:b])) is not None and len(out)]
        if found:
            yield pd.concat(found, ignore_index=True)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes reaches over the links, by repeated hooking and halving."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
