"""Helpers the operators of this subpackage share.

Scratch tables.  Lineage is cut by writing Parquet under the folder that the
session names in ``spark.checkpoint.dir`` (every executor can read it, so a
lost executor costs a re-read, not a re-run).  Only where that setting is unset and
the master is local, as in tests, a temporary folder is made for it; a cluster
without the setting is an error.
"""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to Python at once: texts may be very long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 512, "8m"

#: The six bytes that part words: space and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def by_value(module_name: str) -> None:
    """Ship a module's functions inside the tasks, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        root = spark.sparkContext.getCheckpointDir()
    return str(root).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing depends on any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, for this session from now on: plans read the setting when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def crc_bucket(column: Column | str, n: int) -> Column:
    """crc32 of a value written as text, modulo n (null: counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string").cast("binary")), F.lit(n))


def word_count(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def hashable(docs: DataFrame) -> list[Column]:
    """All of a row's values in a form that can be hashed: maps by their sorted entries, what holds them deeper as JSON."""
    out = []
    for f in docs.schema:
        kind, column = f.dataType.simpleString(), F.col(quoted(f.name))
        if "map<" not in kind and "variant" not in kind:
            out.append(column)
        elif kind.startswith("map<") and "map<" not in kind[4:] and "variant" not in kind:
            out.append(F.array_sort(F.map_entries(column)))
        else:
            out.append(F.to_json(F.struct(column.alias("x"))))
    return out


def row_key(docs: DataFrame) -> Column:
    """16 bytes of all of a row's values, nulls told apart from nothing: equal rows alone share it."""
    values = hashable(docs) + [F.col(quoted(c)).isNull() for c in docs.columns]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *values)), 16, "0") for seed in (17, 23)]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
