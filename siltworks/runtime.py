"""What operators need of the session: durable intermediate results, parallelism, column checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder is named in spark.checkpoint.dir. A temporary one serves a local master only, where all tasks share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share; intermediate results need one")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: later stages read files and don't recompute after a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that live as long as a `with` block: compact, read column by column, deleted at its end.

    What leaves the block must be made durable in it.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def put(self, df: DataFrame) -> DataFrame:
        """The same rows, written and read again."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(conf).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition a core, for Python stages over an input of few splits. Larger inputs stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


#: Most bits of a sift, in words of 64: what is broadcast stays under 2^19 rows of two numbers, whatever the number of keys.
SIFT_BITS = 2**25


def sift(df: DataFrame, column: str, keys: DataFrame, bits: int = SIFT_BITS) -> DataFrame:
    """df without most of the rows whose column isn't among keys (of one column), before a join with these; it isn't shuffled for that.

    A row whose key is there always stays. Keys that share a bit with one that is there stay too, more of them the more keys there are.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word, bit = (lambda c: F.shiftright(at(c), 6)), (lambda c: at(c).bitwiseAND(F.lit(63)).cast("int"))
    key = keys.columns[0]
    words = keys.groupBy(word(key).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(key))).alias("_bits"))
    return df.withColumn("_word", word(column)).join(F.broadcast(words), "_word").filter(F.getbit("_bits", bit(column)) == 1).drop("_word", "_bits")


def require(df: DataFrame, *columns: str) -> None:
    """One error that names every missing column."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def forbid(df: DataFrame, *columns: str) -> None:
    if there := [c for c in columns if c in df.columns]:
        raise ValueError(f"columns already there: {', '.join(there)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
