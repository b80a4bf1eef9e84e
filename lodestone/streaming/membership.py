"""Classes of duplicates kept up to date: a batch of runs touches the signatures and buckets that are its own.

Three keyed tables (``sources.keyed``) hold what ``similarity.clusters`` works out: each run's signatures by run, by precise
signature, and by coarse bucket with the class that the precise one gives.  Of the runs met before, a batch reads those of its
signatures, and changes the buckets of those that get or lose a fellow by it.  Classes are then read from the buckets, without the signatures.

The tables are written in the order buckets, signatures, runs, so a batch that broke off and is put again gives the same tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity, state
from ..sources import scratch
from ..sources.keyed import PARTS, KeyedTable


class Membership:
    """``kind`` is the type of run keys; ``o`` orders runs (the key itself by default)."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", order: str | None = None, parts: int = PARTS):
        by = order or kind
        self.runs = KeyedTable(spark, f"{path}/runs", "k", f"k {kind}, p string, c string, o {by}", parts)
        self.signatures = KeyedTable(spark, f"{path}/signatures", "p", f"p string, k {kind}, c string, o {by}", parts)
        # b: the bucket, or the run itself where it has none
        self.buckets = KeyedTable(spark, f"{path}/buckets", "b", f"b string, k {kind}, c string, o {by}, cluster string", parts)

    def put(self, signatures: DataFrame, key: str = "run_key", precise: str = "root_graph", coarse: str = "cause_tuple", order: str | None = None) -> None:
        """Add runs, or replace them."""
        batch = scratch.materialize(signatures.select(F.col(key).alias("k"), F.col(precise).cast("string").alias("p"), F.col(coarse).cast("string").alias("c"), F.col(order or key).alias("o")))
        prior = scratch.materialize(self.runs.of(batch))
        both = batch.unionByName(prior)
        touched = both.where("p is not null").select("p").distinct()
        held = scratch.materialize(self.signatures.of(touched))
        new = held.join(batch.select("k"), "k", "left_anti").select("k", "p", "c", "o").unionByName(batch.where("p is not null"))
        count = lambda rows, name: rows.groupBy("p").agg(F.count(F.lit(1)).alias(name))
        sizes = touched.join(count(held, "before"), "p", "left").join(count(new, "after"), "p", "left")
        shared = lambda c: F.coalesce(F.col(c), F.lit(0)) >= 2
        sizes = scratch.materialize(sizes.select("p", shared("after").alias("owned"), (shared("before") != shared("after")).alias("turned")))
        # the batch, and those met before that have a fellow since, or none any more
        turned = held.join(batch.select("k"), "k", "left_anti").join(sizes.where("turned"), "p").select("k", "p", "c", "o", "owned")
        fresh = batch.join(sizes.select("p", "owned"), "p", "left").select("k", "p", "c", "o", "owned")
        cluster = F.when(F.col("owned"), F.concat(F.lit("0:"), "p"))
        bucket = F.coalesce(F.concat(F.lit("c:"), "c"), F.concat(F.lit("k:"), F.col("k").cast("string")))
        changed = scratch.materialize(fresh.unionByName(turned).select(bucket.alias("b"), "k", "c", "o", cluster.alias("cluster")))
        left = prior.select(bucket.alias("b"), "k")
        gone = changed.select("k").unionByName(left.select("k")).distinct()
        self.buckets.update(changed.select("b").unionByName(left.select("b")), lambda old: old.join(gone, "k", "left_anti").select(*changed.columns).unionByName(changed))
        self.signatures.update(touched, lambda old: old.join(batch.select("k"), "k", "left_anti").select("p", "k", "c", "o").unionByName(batch.where("p is not null").select("p", "k", "c", "o")))
        self.runs.update(batch, lambda old: state.replace_rows(old, batch, "k"))
        for done in (batch, prior, held, sizes, changed):
            scratch.discard(done)

    def members(self, key: str = "run_key", most: int = 500) -> DataFrame:
        """As ``similarity.clusters``, of all runs put so far."""
        return similarity.placed(self.buckets.read().select("k", "c", "o", "cluster"), key, most)


def members_of_batches(spark: SparkSession, batches: list[DataFrame], kind: str, key: str) -> DataFrame:
    """The classes after so many batches, kept in the shared scratch folder."""
    import uuid

    held = Membership(spark, f"{scratch.root(spark)}/members/{uuid.uuid4().hex}", kind)
    reduce(lambda _, b: held.put(b, key), batches, None)
    return held.members(key)
