"""Connected components of a graph held in DataFrames, by DataFrame operations only.

Alternating large-star and small-star rounds (Kiveris et al., 2014).  Each round
is two shuffles of the edge list; node labels never leave the executors.  A round's
edges are written to the shared scratch folder, and the round before is deleted.
A hot node's minimum is pre-aggregated before the shuffle; only its minimum travels
to it, and the join that hands the minimum out is one that AQE may split.

Nodes may be of any orderable type.  Self-loops and repeated edges are allowed,
rows with a null end are ignored.  The result has a row for each node that has an
edge to another: ``node`` and ``component``, its smallest reachable node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (larger, smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    current = materialize(pairs, "cc0")
    mark = None
    for n in range(1, max_rounds + 1):
        following = materialize(_small_star(_large_star(current)), f"cc{n}")
        # done when the forest is flat and stays so: the same edges again (count and order-free sums of their hashes)
        seen = following.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(current)
        current = following
        if mark == seen or seen["n"] == 0:
            break
        mark = seen
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
