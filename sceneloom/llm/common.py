"""What the operators of this subpackage share: words, scratch tables, ordered numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters.
BREAKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


#: New folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session may fall back to a new one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-scratch-")
        _OWN[spark.sparkContext.applicationId] = root
    return root


class Scratch:
    """Tables written under spark.checkpoint.dir to cut lineage.

    A written table survives the loss of any executor and is read again with
    its own schema, so that an empty one reads as well.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{owner}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_ids(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` written with ``__rid``, a number that only the row has, so that narrow results can be joined back to it.

    Names that begin with two underscores are the operators' own.
    """
    return scratch.keep(docs.withColumn("__rid", F.monotonically_increasing_id()), "documents")


def _ranged(df: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` in the order of ``keys`` (nulls first): ``__part``, then ``__row`` in it.

    Sampled splitters range-partition the rows and each partition sorts its
    own, so no task sees more than its share. The table is written, so that
    the places stay as they are. Rows equal in all keys may swap places.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return scratch.keep(ranged.withColumns({"__part": F.shiftright(row, 33).cast("int"), "__row": row.bitwiseAND(F.lit((1 << 33) - 1))}), name)


def _starts(placed: DataFrame, weight: Column) -> DataFrame:
    """The sum of ``weight`` before each partition. One row for each: bounded by their number, whatever the input."""
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    return placed.groupBy("__part").agg(F.sum(weight).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))


def numbered(df: DataFrame, keys: list[str], scratch: Scratch, name: str, index: str) -> DataFrame:
    """``df`` with ``index``: the row's number, from 0, in the order of ``keys``."""
    placed = _ranged(df, keys, scratch, name)
    return placed.join(F.broadcast(_starts(placed, F.lit(1))), "__part").withColumn(index, F.col("__from") + F.col("__row")).drop("__part", "__row", "__from")


def summed_before(df: DataFrame, keys: list[str], weight: str, scratch: Scratch, name: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over the rows that come before in the order of ``keys``."""
    placed = _ranged(df, keys, scratch, name)
    inside = W.partitionBy("__part").orderBy("__row").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.withColumn("__sum", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return sums.join(F.broadcast(_starts(placed, F.col(weight))), "__part").withColumn(out, F.col("__from") + F.col("__sum")).drop("__part", "__row", "__from", "__sum")
