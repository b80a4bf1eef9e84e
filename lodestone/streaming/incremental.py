"""Incremental collection: each new file is taken up once, state is merged, cursors only move on.

The cursor of a collection is a resume point, not an event-time watermark: nothing is ever
dropped for being late.  A stream's checkpoint holds it; ``foreachBatch`` merges a batch
into the partitions of its keys (see ``sources.keyed``), so a batch costs what it touches, and one that
is run again gives the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..sources import scratch
from ..sources.keyed import KeyedTable


def collect(spark: SparkSession, source: DataFrame, table: KeyedTable, checkpoint: str, key: str, order: list[str], text=state.TEXT_STICKS, null=state.NULL_STICKS, last=("checked_at",)) -> None:
    """Run a stream of updates until it has taken up all there is, merging each batch into ``table``."""

    def take(batch: DataFrame, number: int) -> None:
        folded = state.fold_updates(batch, key, order, text, null, last)
        table.update(folded, lambda old: state.merge(old, folded, key, text, null, last))

    source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_files(spark: SparkSession, path: str, key: str, order: list[str], column: str, batch_bytes: int = 16 << 30) -> DataFrame:
    """The state of a folder's updates: per key the last value of ``column`` and when it was updated last."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxBytesPerTrigger", batch_bytes).parquet(f"{folder}/{name}*")
    source = source.select(key, *order, column).withColumn("checked_at", F.col(order[0]))
    base = f"{scratch.root(spark)}/streams/{uuid.uuid4().hex}"
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    table = KeyedTable(spark, f"{base}/table", key, f"{key} {kinds[key]}, {column} {kinds[column]}, checked_at {kinds['checked_at']}")
    collect(spark, source, table, f"{base}/checkpoint", key, order, (column,), (), ("checked_at",))
    return table.read()


def unseen(listing: DataFrame, known: DataFrame, key: str, created: str, limit: int) -> DataFrame:
    """What a sweep takes up: not known yet, oldest first, at most ``limit``."""
    return listing.join(known.select(key), key, "left_anti").orderBy(F.coalesce(created, F.lit("1970-01-01").cast("timestamp")), key).limit(limit)


def next_cursor(stored: DataFrame, failed: DataFrame, created: str, old):
    """The cursor after a sweep: the latest stored, held at the oldest failure, never back."""
    top = stored.agg(F.max(created).alias("t")).first()["t"]
    hold = failed.agg(F.min(created).alias("t")).first()["t"]
    new = min(x for x in (top, hold) if x is not None) if top is not None or hold is not None else None
    return max((x for x in (old, new) if x is not None), default=None)


def refresh(before: DataFrame, listing: DataFrame, complete: bool, key: str, checked_at, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what changed, ids to touch): absence from a complete listing means unchanged since, from a cut-off one nothing."""
    diff = state.snapshot_diff(before, listing, key, columns)
    touched = diff.where("change = 'removed'").select(key) if complete else diff.where("false").select(key)
    return diff.where("change in ('added', 'changed')"), touched
