"""The triage worklist: every run in exactly one bucket, by one ordered CASE; and the to-do order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ("status-unknown", "duplicate-conflict", "done", "mark-duplicate", "candidate-invalid", "diagnosed-unrecorded", "needs-read")
UNRECORDED = ("New", "Incomplete")
CLOSED = ("Fix Released", "Invalid", "Won't Fix", "Opinion", "Expired", "Does Not Exist")
IMPORTANCE = ("Critical", "High", "Medium", "Low", "Wishlist", "Undecided")


def importance_rank(importance: Column) -> Column:
    out = F.lit(len(IMPORTANCE))
    for k in range(len(IMPORTANCE) - 1, -1, -1):
        out = F.when(importance == IMPORTANCE[k], k).otherwise(out)
    return out


def triage_rows(runs: DataFrame, bug_state: DataFrame) -> DataFrame:
    """Runs with what the tracker says of their bug; narrow columns only, never a payload."""
    s = bug_state.select("bug_id", "status", "duplicate_of", "is_duplicate", "assignee", "importance", F.col("title").alias("_title"), "checked_at")
    return runs.join(s, "bug_id", "left").withColumn("title", F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.col("current_title"))).drop("_title")


def is_confident(cause: Column, complete: Column) -> Column:
    return cause.isNotNull() & F.coalesce(complete, F.lit(False)) & ~F.coalesce(cause, F.lit("")).isin("unknown", "no_failure_recorded", "")


def is_diagnosed(cause: Column) -> Column:
    return cause.isNotNull() & ~F.coalesce(cause, F.lit("")).isin("unknown", "no_failure_recorded", "")


def classify(rows: DataFrame, members: DataFrame, chain_roots: DataFrame) -> DataFrame:
    """Adds ``bucket``, ``master`` (class representative), ``tier`` and ``done_as`` to triage rows.

    ``rows``: run_key, bug_id, top_cause, evidence_complete, third_party, and the tracker's columns.
    ``members``: run_key, canonical, tier.  ``chain_roots``: bug_id, root of the tracker's chains.
    First match wins: unknown status, masters in conflict, done, mark duplicate, invalid
    candidate, diagnosed but unrecorded, needs reading; anything else is done as its status.
    """
    m = members.select("run_key", F.col("canonical").alias("master"), "tier")
    heads = rows.select(F.col("run_key").alias("master"), F.col("bug_id").alias("master_bug"), is_diagnosed(F.col("top_cause")).alias("master_diagnosed")).distinct()
    chain = lambda name: chain_roots.select(F.col("bug_id").alias(name), F.col("root").alias(f"{name}_root"))
    j = rows.join(m, "run_key", "left").join(heads, "master", "left").join(chain("duplicate_of"), "duplicate_of", "left").join(chain("master_bug"), "master_bug", "left")
    own = F.coalesce(F.col("master") == F.col("run_key"), F.lit(False))
    root = lambda name: F.coalesce(f"{name}_root", name)
    differ = F.col("duplicate_of").isNotNull() & F.col("master").isNotNull() & ~own & ~F.coalesce(F.col("duplicate_of") == F.col("master_bug"), F.lit(False)) & (F.col("master_bug").isNull() | (root("duplicate_of") != root("master_bug")))
    dup = F.coalesce("is_duplicate", F.lit(False))
    known, sure = is_diagnosed(F.col("top_cause")), is_confident(F.col("top_cause"), F.col("evidence_complete"))
    invalid = (F.col("top_cause") == "third_party_pin") & F.coalesce("third_party", F.lit(False))
    fresh = F.col("status").isin(*UNRECORDED)
    yes = lambda c: F.coalesce(c, F.lit(False))
    bucket = (
        F.when(F.coalesce("status", F.lit("")) == "", "status-unknown")
        .when(yes(differ), "duplicate-conflict")
        .when(yes(F.col("status").isin(*CLOSED)) | dup, "done")
        .when(yes((F.col("tier") == 0) & ~own & known & F.col("master_diagnosed")), "mark-duplicate")
        .when(yes(invalid), "candidate-invalid")
        .when(yes(sure & known & fresh), "diagnosed-unrecorded")
        .when(yes(~sure & fresh), "needs-read")
        .otherwise("done")
    )
    out = j.withColumn("bucket", bucket)
    return out.withColumn("done_as", F.when(F.col("bucket") == "done", F.when(dup, "already a duplicate").otherwise(F.col("status")))).drop("master_bug", "master_diagnosed", "duplicate_of_root", "master_bug_root")


def tallies(items: DataFrame) -> DataFrame:
    return items.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("checked_at").alias("oldest_check"), F.max("checked_at").alias("newest_check"))


def stale(items: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row: whether the oldest check (or its absence) makes the list stale."""
    return items.agg(F.coalesce(F.datediff(now, F.min("checked_at")) >= days, F.lit(True)).alias("stale"))


def todo(items: DataFrame, assignee: str = "") -> DataFrame:
    """Own work in progress first, then all that is triaged; by importance, bug, run."""
    mine = (F.col("status") == "In Progress") & (F.col("assignee") == assignee) if assignee else F.lit(False)
    part = F.when(mine, 0).when(F.col("status") == "Triaged", 1)
    rows = items.withColumn("part", part).where("part is not null").withColumn("importance_rank", importance_rank(F.col("importance")))
    return rows.orderBy("part", "importance_rank", F.coalesce("bug_id", F.lit(0)), "run_key")
