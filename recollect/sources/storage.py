"""The folder that all executors share, and frames kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder of ours only where that is unset and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        path = tempfile.mkdtemp(prefix="recollect-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own.append(f"file://{path}")
    return _own[0]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and lost executors lose none of it."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    base = shared_folder(spark)
    return f"{base if ':' in base else f'file://{base}'}/{name}-{uuid.uuid4().hex[:12]}"
