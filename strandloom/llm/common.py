"""What the operators here share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import components

__all__ = ["SPACE", "boxed", "components", "join_skewed", "row_key", "words"]

#: White space of all contracts: space and the five ASCII control blanks.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, null as empty: maximal runs of anything but the six ASCII blanks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def boxed(docs: DataFrame, *columns: str) -> tuple[Column, str]:
    """The columns as one struct ``k`` with fields k0, k1, ..., and its type: whole numbers of a struct reach pandas as
    they are, where those of a column with nulls become floats and lose digits."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    fields = ", ".join(f"k{i}: {kinds[c]}" for i, c in enumerate(columns))
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]).alias("k"), f"k struct<{fields}>"


def row_key(*columns: str) -> Column:
    """128 bits of the columns' values, as a struct of two longs: rows with equal values share it, others do not."""
    cols = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])  # a null value leaves a hash as it was
    return F.struct(F.xxhash64(nulls, *cols).alias("a"), F.xxhash64(F.lit(1), nulls, *reversed(cols)).alias("b"))


#: A key is hot if it has more than a HOT_SHARE of all rows, and LEAST_HOT of them; so there are fewer hot keys than
#: 1 / HOT_SHARE, whatever the size of the table.
HOT_SHARE, LEAST_HOT = 1 / 65_536, 256


def join_skewed(rows: DataFrame, named: DataFrame, keys: list[str], count: str = "_n") -> DataFrame:
    """``rows`` inner joined by ``keys`` with ``named``, which has one row a key and, as ``count``, how often ``rows`` has it.

    Hot keys are joined where their rows are, with a broadcast of a bounded number of rows; the others by shuffle.
    ``rows`` is read twice and ``named`` more often, so that one should be a written table. ``count`` is left out.
    """
    total = named.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(LEAST_HOT, int(total * HOT_SHARE))
    few = F.broadcast(named.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(named.where(~hot).hint("merge"), keys)
    return rows.join(few, keys).unionByName(rest).drop(count)
