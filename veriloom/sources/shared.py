"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; one is made for this session only where both are unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="veriloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def land(df: DataFrame, kind: str, **options) -> str:
    """Writes a table to a new folder of the shared one, as JSON, CSV, text or Parquet, and returns its path."""
    path = f"{shared_dir(df.sparkSession)}/landed-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table of the shared folder: lineage is cut, and lost executors are survived."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
