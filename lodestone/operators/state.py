"""Mutable tables kept by copy-on-write: merges, look-ups, snapshot differences, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns in which an empty text says nothing, and those in which only null does.
TEXT_STICKS, NULL_STICKS = ("status", "importance", "title"), ("duplicate_of", "is_duplicate", "assignee")


def said(column: str, text: bool) -> Column:
    return F.nullif(F.col(column), F.lit("")) if text else F.col(column)


def fold_updates(updates: DataFrame, key: str, order: list[str], text: tuple[str, ...] = TEXT_STICKS, null: tuple[str, ...] = NULL_STICKS, last: tuple[str, ...] = ("checked_at",)) -> DataFrame:
    """A log of updates to one row a key: in each column the last thing said, in ``last`` the last at all."""
    by = F.struct(*order)
    pick = [F.max_by(said(c, c in text), F.when(said(c, c in text).isNotNull(), by)).alias(c) for c in (*text, *null)]
    return updates.groupBy(key).agg(*pick, *[F.max_by(c, by).alias(c) for c in last])


def merge(current: DataFrame, folded: DataFrame, key: str, text: tuple[str, ...] = TEXT_STICKS, null: tuple[str, ...] = NULL_STICKS, last: tuple[str, ...] = ("checked_at",)) -> DataFrame:
    """Upsert: new keys come in, what an update leaves unsaid stays."""
    a, b = current.alias("a"), folded.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    keep = lambda c: F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")) if c in text else F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[keep(c) for c in (*text, *null)], *[F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in last])


def touch(current: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Set a column where the key is listed; never insert."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return current.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit").select(*current.columns)


def replace_rows(current: DataFrame, new: DataFrame, key: str, preserve: tuple[str, ...] = ()) -> DataFrame:
    """Delete-then-insert by key; columns to ``preserve`` keep what the key's rows had."""
    if preserve:
        old = current.select(key, *[F.col(c).alias(f"_{c}") for c in preserve]).dropDuplicates([key])
        new = new.join(old, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in preserve}).select(*current.columns)
    return current.join(new.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def delete_rows(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return current.join(ids.select(key), key, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, changed): added, removed or changed keys, with the names of what changed."""
    a, b = before.alias("a"), after.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    names = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    gone, fresh = F.col(f"b.{key}").isNull(), F.col(f"a.{key}").isNull()
    change = F.when(fresh, "added").when(gone, "removed").when(F.size(names) > 0, "changed").otherwise("same")
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"), F.when(fresh | gone, F.array().cast("array<string>")).otherwise(names).alias("changed"))


def listing_flags(all_: DataFrame, without: DataFrame, key: str, name: str = "is_duplicate") -> DataFrame:
    """What only the fuller of two listings has is flagged."""
    seen = without.select(key).distinct().withColumn("_seen", F.lit(True))
    return all_.join(seen, key, "left").withColumn(name, F.col("_seen").isNull()).drop("_seen")


def later(old: Column, new: Column) -> Column:
    """A watermark only moves forward."""
    return F.greatest(old, new)


def cache_plan(rows: DataFrame, files: DataFrame, everything: bool = False, most_bytes: int | None = None) -> DataFrame:
    """(name, verdict, size): files against rows: orphan, stale, unusable, forced, kept.

    ``rows``: name, size; ``files``: name, size.
    """
    r, f = rows.select("name", F.col("size").alias("row_size")), files.select("name", F.col("size").alias("file_size"))
    j = r.join(f, "name", "full_outer")
    bad = (F.col("file_size") == 0) | (F.col("file_size") != F.col("row_size"))
    if most_bytes is not None:
        bad = bad | (F.col("file_size") > most_bytes)
    v = F.when(F.col("row_size").isNull(), "orphan").when(F.col("file_size").isNull(), "stale").when(bad, "unusable").when(F.lit(everything), "forced").otherwise("kept")
    return j.select("name", v.alias("verdict"), F.coalesce("file_size", F.lit(0)).cast("long").alias("size"))


def cache_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
