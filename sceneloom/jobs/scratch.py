"""Tables written under the cluster's shared checkpoint folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: New folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, owner: str) -> str:
    """A new folder under spark.checkpoint.dir; a local session without one gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-scratch-")
        _OWN[spark.sparkContext.applicationId] = root
    return f"{root}/{owner}-{uuid.uuid4().hex}"


def keeper(spark: SparkSession, owner: str):
    """A function that writes a table under a name and reads it back."""
    base = shared_folder(spark, owner)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    return keep
