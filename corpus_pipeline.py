"""From documents to tokens: toxic documents go, recurring lines go, near copies go, sources are mixed, text is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the shared folder as Parquet
and reads it back for the next, so a lost executor costs a stage at most.

All stages take rows with nulls in any column, empty and very long texts, repeated rows, and further columns of any
name, which they hand on; an empty table gives an empty result. What each makes of them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, linededup, mixing, simhash, toxicity
from strandloom.llm.registry_base import register
from strandloom.session import discard, mark, sweep, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on those of the labels, does not reject.

    Null and empty texts score 0 and stay; rows are judged each on its own, so repeats and null ids make no difference.
    Without labels nothing is rejected.
    """
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; n_chars follows the text.

    Every row stays. Null texts stay null, with a null n_chars; rows equal in id and text are one document and make no
    template recur; equal lines of several documents stay in the one with the smaller id, null before all.
    """
    # other columns wait in a struct, where none of their names can clash
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    box = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if rest else []
    left = linededup.deduplicated(docs.select("doc_id", "text", *box))
    value = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by doc_id, null ids last and then by a hash of the text.

    Rows without an id, or that share one, are documents of their own if their texts differ; rows equal in both are one.
    Null and blank texts are one group.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, at most ``mixing.MAX_EPOCHS`` times.

    Null is a source like others. Null and empty texts weigh nothing and are taken as often as others at their place;
    rows equal in id and text are taken together.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their digests, beside what identifies a document, a row for every row.

    Null texts are encoded as empty ones, with no ids. Null ids are handed on; other columns are not.
    """
    return bpe.encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: A trained model, hash fingerprints and a tokenizer's vocabulary are beyond SQL; tests hold a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Each one's own tables, and its input, are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since, before = mark(), docs
        docs = written(stage(spark, docs, sf_dir), name)
        sweep(spark, since, docs)
        discard(before)
    return docs


register("pipeline", ORACLE_SQL)(run)
