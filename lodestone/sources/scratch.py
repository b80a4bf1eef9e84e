"""Intermediate tables in the folder the session shares between its executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; on one machine alone, a temporary one where both are unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        path = spark.sparkContext.getCheckpointDir()
    return str(path).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write and read back: the lineage ends at a table every executor can read."""
    path = f"{root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def tidy(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more deleted; else they stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()
