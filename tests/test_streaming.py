"""Streams give what a batch over the same files gives."""

from pyspark.sql import functions as F

from strandloom.operators.kmer import kmer_table
from strandloom.streaming.incremental import running_gene_counts, running_kmer_counts


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_running_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, s in enumerate(["ACGTACGTT", "ttacgn", "GGGGG"]):
        spark.createDataFrame([(s,)], "seq string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r.kmer, r.n) for r in run(spark, running_kmer_counts(stream, 3), "kmers", "complete").collect()}
    batch = spark.read.parquet(src).select(F.lit(1).alias("id"), F.upper("seq").alias("seq"))
    want = {(r.kmer, r["count"]) for r in kmer_table(batch, "id", "seq", 3, both_strands=True).groupBy("kmer").count().collect()}
    assert got == want

    calls = str(tmp_path / "calls")
    for rows in ([("a", "x"), ("a", "x")], [("b", "x"), ("a", "y")], [("a", "x")]):
        spark.createDataFrame(rows, "genome string, gene string").coalesce(1).write.mode("append").parquet(calls)
    stream = spark.readStream.schema("genome string, gene string").option("maxFilesPerTrigger", 1).parquet(calls)
    assert sorted(map(tuple, run(spark, running_gene_counts(stream), "genes", "complete").collect())) == [("x", 2), ("y", 1)]
