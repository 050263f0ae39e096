"""FASTA and FASTQ files, gzip or not, and lists of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import isolate_name


def read_paths(spark: SparkSession, listing: str, is_ref: bool = True) -> DataFrame:
    """(genome_id, path, isolate, is_ref) from a text file with a path a line; ids follow the lines."""
    lines = [r.value.strip() for r in spark.read.text(listing).collect() if r.value.strip()]
    return spark.createDataFrame([(i, p, is_ref) for i, p in enumerate(lines)], "genome_id int, path string, is_ref boolean").withColumn("isolate", isolate_name(F.col("path")))




def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, record, id, description, seq): the records of FASTA or FASTQ files, upper case, from 0 in file order.

    A file is one value, as records span lines; Spark reads gzip itself. Files are the unit of work, as genomes are
    of the analysis; split read archives before.
    """
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("text"))
    fasta = files.where(F.col("text").startswith(">")).select("path", F.posexplode(F.split(F.substr("text", F.lit(2)), "\n>")).alias("record", "r"))
    head, body = F.substring_index("r", "\n", 1), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "")
    one = fasta.select("path", "record", head.alias("h"), F.upper(body).alias("seq"))
    rows = files.where(F.col("text").startswith("@")).select("path", F.split("text", "\n").alias("l"))
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (i % 4 == 0) & (F.length(F.get("l", i)) > 0)))
    fastq = rows.select("path", "l", at.alias("i")).select("path", (F.col("i") / 4).cast("int").alias("record"), F.substr(F.get("l", F.col("i")), F.lit(2)).alias("h"), F.upper(F.get("l", F.col("i") + 1)).alias("seq"))
    both = one.unionByName(fastq)
    return both.select("path", "record", F.regexp_extract("h", r"^\S*", 0).alias("id"), F.trim(F.regexp_replace("h", r"^\S*", "")).alias("description"), "seq")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, seq): FASTA if the file begins with >, else a sequence a line, numbered."""
    first = spark.read.text(path).first()
    if first is not None and first.value.startswith(">"):
        return read_fasta(spark, path).select(F.col("id").alias("query_id"), "seq")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "s"))
    return lines.where("trim(s) <> ''").select(F.col("i").cast("string").alias("query_id"), F.upper(F.trim("s")).alias("seq"))


def fasta_lines(df: DataFrame, header, seq) -> DataFrame:
    """One text column, a record a row, for ``write.text``."""
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))


def gene_fasta(genes: DataFrame, protein: bool = False) -> DataFrame:
    """Text of .ffn or .faa: genes (isolate, orf_id, cluster, annotation, pseudo, dna, protein)."""
    header = F.concat(F.col("isolate"), F.lit("_"), F.col("orf_id").cast("string"), F.lit(" cluster="), F.col("cluster").cast("string"), F.when(F.coalesce(F.col("annotation"), F.lit("")) != "", F.concat(F.lit(" "), F.col("annotation"))).otherwise(""), F.when(F.col("pseudo"), "(pseudogene)").otherwise(""))
    return fasta_lines(genes, header, F.col("protein" if protein else "dna"))


def pangenome_reference(clusters: DataFrame) -> DataFrame:
    """(gene, centroid, dna): one sequence a cluster, its first centroid's; a centroid that an earlier cluster (by
    name) has given is not written again. clusters (gene, centroids: array of ids, dna: of the first)."""
    first = clusters.select("gene", F.get("centroids", F.lit(0)).alias("centroid"), "dna")
    return first.groupBy("centroid").agg(F.min(F.struct("gene", "dna")).alias("x")).select("x.gene", "centroid", "x.dna")


def query_fasta(hits: DataFrame) -> DataFrame:
    """Text of the ORFs that queries met: hits (isolate, orf_id, queries: array, annotation, dna)."""
    header = F.concat(F.col("isolate"), F.lit("_"), F.col("orf_id").cast("string"), F.lit(" QUERY="), F.array_join("queries", ";"), F.lit(" annotation="), F.coalesce("annotation", F.lit("")))
    return fasta_lines(hits, header, F.col("dna"))
