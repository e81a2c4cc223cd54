"""Written intermediate tables of the library's plans, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.  Where that is unset, a session on this machine alone gets a temporary
    one; on a cluster no machine's own folder would do, so that raises."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="spark-scratch-")).as_uri()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return the written table: what is read more than once is made once, and lineage ends here."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
