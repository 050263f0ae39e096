"""Session helpers: the one place that knows about scratch space."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


#: Where the tables of ``written`` lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Folders that were written, in order; what was deleted since is not taken out.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset, a temporary one is set if the driver
    and the executors are one process on one machine (tests); on a cluster that would lose data, so it is an error."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-strandloom-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return f"{folder}/strandloom-{sc.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    It stays until ``discard`` or ``clear``, as results that are read later depend on it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _made.append(path)
    return out


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table of ``written``, so that reading it again costs no more than that."""
    return df in _paths


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` on which nothing depends that is still to be computed."""
    for df in tables:
        if df in _paths:
            _delete(df.sparkSession, _paths.pop(df))


class Pile:
    """Tables of one schema that rounds write, each to be read alone or all as one: no plan grows with the rounds."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.rounds = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        _made.append(self.path)

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round; what is returned reads it again."""
        self.rounds, path = self.rounds + 1, f"{self.path}/round={self.rounds}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, schema: StructType) -> DataFrame:
        """All rounds so far, with the column ``round``."""
        out = self.spark.read.schema(StructType([*schema.fields, StructField("round", IntegerType())])).parquet(self.path)
        _paths[out] = self.path
        return out


def mark() -> int:
    """A point in time for ``sweep``."""
    return len(_made)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables written since a ``mark``, but for those of ``keep``: a stage's own, once its result is stored."""
    kept = {_paths[df] for df in keep if df in _paths}
    for path in _made[since:]:
        if path not in kept:
            _delete(spark, path)
    _made[since:] = [p for p in _made[since:] if p in kept]


def clear(spark: SparkSession) -> None:
    """Delete all that ``written`` left behind in this application, once the results are stored."""
    _delete(spark, shared_folder(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark touches the path, so any store Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Spread a table over the cores if its files make fewer tasks than there are; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
