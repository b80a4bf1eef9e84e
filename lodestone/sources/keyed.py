"""Keyed state in Parquet: partitioned by a hash of the key, changed by Spark's dynamic partition overwrite.

A batch reads and rewrites only the partitions of its own keys.  The rewritten partitions are worked out in the shared
scratch folder first, so none is read while it is replaced.  An update that was interrupted and is run again with the
same batch gives the same table, as long as applying a batch twice gives what applying it once gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

PARTS, PART = 64, "_part"


class KeyedTable:
    """Rows of one or more per key.  ``parts`` is fixed for a table's life, so it is part of its path."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, parts: int = PARTS):
        self.spark, self.key, self.parts = spark, key, parts
        self.path = f"{path.rstrip('/')}/by-{key}-{parts}"
        self.empty = spark.createDataFrame([], schema)
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        #: Partitions that the last update rewrote.
        self.rewritten: list[int] = []

    def part(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.parts)).cast("int")

    def exists(self) -> bool:
        return bool(self._fs.exists(self._path(self.path)))

    def _rows(self) -> DataFrame:
        if not self.exists():
            return self.empty.withColumn(PART, F.lit(0))
        # columns that an older version lacks are null
        schema = T.StructType([*self.empty.schema.fields, T.StructField(PART, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(PART)

    def touched(self, keys: DataFrame) -> list[int]:
        """The partitions of some keys, at most ``parts``."""
        return sorted(r[0] for r in keys.select(self.part().alias("p")).distinct().collect())

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their partitions are read."""
        parts = self.touched(keys)
        return self._rows().where(F.col(PART).isin(parts) if parts else F.lit(False)).drop(PART).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the partitions of ``keys`` by what ``change`` makes of their rows; it may not make rows of other partitions."""
        parts = self.touched(keys)
        self.rewritten = parts
        if not parts:
            return
        old = self._rows().where(F.col(PART).isin(parts)).drop(PART)
        new = scratch.materialize(change(old).select(*self.empty.columns).withColumn(PART, self.part()))
        held = {r[0] for r in new.select(PART).distinct().collect()}
        if strange := held - set(parts):
            raise ValueError(f"rows of partitions {sorted(strange)} that the keys are not in")
        new.repartition(len(parts), PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        for p in set(parts) - held:  # what has no row left is not overwritten
            self._fs.delete(self._path(f"{self.path}/{PART}={p}"), True)
        scratch.discard(new)

    def replace(self, rows: DataFrame) -> None:
        """The whole table anew."""
        kept = scratch.materialize(rows.select(*self.empty.columns).withColumn(PART, self.part()))
        self.rewritten = list(range(self.parts))
        if self.exists():
            self._fs.delete(self._path(self.path), True)
        kept.repartition(PART).write.partitionBy(PART).parquet(self.path)
        scratch.discard(kept)
