"""Tables written once to the folder that all executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Unset, a local master gets a temporary folder, a cluster the warehouse."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _local()
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


@cache
def _local() -> str:
    path = tempfile.mkdtemp(prefix="tiles-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table of the shared folder: computed once, and there after the loss of executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
