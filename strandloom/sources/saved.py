"""Results kept between runs: ORFs, edges, clusters and the query index as Parquet with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a saved table must have; further columns are kept as they are.
SCHEMAS = {
    "orfs": "genome_id long, orf_id long, dna string, score double",
    "edges": "genome_id long, src long, dst long",
    "clusters": "cluster_id long, genome_id long, orf_id long",
    "index": "node_id long, genome_id long, orf_id long",
}
#: The column by which rows lie together and in order, so that one genome is read by its pages, without the others.
#: Genomes have no folders of their own, as these would be as many as there are genomes.
ORDERED = {"orfs": "genome_id", "edges": "genome_id"}


def checked(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with the schema's columns first, cast without loss; a missing one or another type is an error."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wanted = T.StructType.fromDDL(SCHEMAS[kind])
    missing = [f.name for f in wanted if f.name not in have]
    if missing:
        raise ValueError(f"{kind}: no column {', '.join(missing)}")
    wrong = [f.name for f in wanted if isinstance(f.dataType, T.LongType) and not isinstance(have[f.name], T.IntegralType) or isinstance(f.dataType, T.StringType) and not isinstance(have[f.name], T.StringType) or isinstance(f.dataType, T.DoubleType) and not isinstance(have[f.name], T.NumericType)]
    if wrong:
        raise ValueError(f"{kind}: other types than {SCHEMAS[kind]} in {', '.join(wrong)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted], *[F.col(f"`{c}`") for c in df.columns if c not in wanted.fieldNames()])


def save(df: DataFrame, kind: str, path: str) -> None:
    """Write a table of ``kind``; an existing one is an error, as by Spark's default."""
    out = checked(df, kind)
    by = ORDERED.get(kind)
    (out.hint("rebalance", by).sortWithinPartitions(by) if by else out).write.parquet(path)


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Read a table of ``kind`` and check its schema."""
    return checked(spark.read.parquet(path), kind)
