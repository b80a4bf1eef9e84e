"""Mixing sources to target weights by entropy balancing.

Given per-source token targets, the document rates ``r`` that stay closest (in
relative entropy) to one copy each, subject to ``sum(r * size) = target`` in every
source and ``0 <= r <= most``, are exponentially tilted:

    r = min(most, exp(theta[source] * size / scale[source]))

with one dual variable per source.  The dual is convex and separates by source, so
each Newton iteration is one distributed aggregation that moves every source's
``theta`` at once (safeguarded by its bracket).  Documents of one source and size
share a rate, so the iterations run over a (source, size) histogram, not documents.

Rounding.  Within a source, cells go from the largest size to the smallest; a
cell's copies are the difference of the rounded running sums of rates, so every
prefix is within half a document of its rate.  What a source still lacks or has in
excess is then settled by passes that add or take copies of sizes no larger than
the remainder, largest first; where none is left, by the one copy that comes nearest.  A cell's copies are dealt evenly to its documents in
the order of a hash of the id; no document gets more than ``most`` copies.
Running sums are two-level (blocks, then rows in a block), so no source is a
single task; ranks inside a cell are counted by hash bucket for the same reason.

Targets.  Sources ordered by code point, null last, take the weights ``(5, 2, 1)`` in
turn and share all words; a target stops at ``most`` times its source's words and
the excess is shared again by weight until none is above.

Defined results.  Null text has size 0.  Documents of size 0 keep one copy and take
no words.  Repeated rows count each; texts are counted whole.  A null id is an id like any other.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS, MOST = (5, 2, 1), 3
#: Hash buckets in which a cell's documents are ranked.
BUCKETS = 64
#: Rounds after which a loop that should have ended is an error.
NEWTON_ROUNDS, SETTLE_ROUNDS = 200, 200


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``: 0, 1, ... by code point, null last, without a single-partition sort."""
    n = max(1, min(64, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = materialize(parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))), "mix-places")
    before, offset = [], 0
    for r in sorted(parts.groupBy("part").count().collect()):  # a row per partition, at most 64
        before.append((r["part"], offset))
        offset += r["count"]
    offsets = F.coalesce(*[F.when(F.col("part") == p, F.lit(o)) for p, o in before]) if before else F.lit(0)
    return parts.withColumn("place", offsets.cast("long") + F.col("at") - 1).drop("part", "at")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target`` added.

    level is the words per unit of weight: raising it to
    (total - capped words) / (uncapped weight) until nothing new is capped is the sharing
    of the excess, one aggregation a time.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    ranked = materialize(_ranked(sources).withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        s = ranked.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w"), F.count_if(full).alias("n")).first()
        if not s["w"] or s["n"] == capped:
            break
        capped, level = s["n"], (total - s["c"]) / s["w"]
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level if level is not None else 0.0))).drop("place", "weight")


def _solve(cells: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """theta per source by distributed Newton iterations on the dual."""
    scale = cells.groupBy("skey").agg(F.max("size").alias("scale"))
    state = materialize(goals.join(scale, "skey").select("skey", "target", F.greatest("scale", F.lit(1)).cast("double").alias("scale"), "source_size", F.lit(0.0).alias("theta"), F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi")), "mix-theta")
    for _ in range(NEWTON_ROUNDS):
        z = F.col("theta") * F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(most)), F.exp(F.least(z, F.lit(5.0))))
        x = F.col("size") / F.col("scale")
        sums = cells.where("size > 0").join(state, "skey").groupBy("skey").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"),
            F.sum(F.when(z < F.log(F.lit(float(most))), F.col("n") * F.col("size") * x * F.exp(F.least(z, F.lit(5.0)))).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("words") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("theta")).otherwise(F.col("lo")), F.when(gap > 0, F.col("theta")).otherwise(F.col("hi"))
        newton = F.col("theta") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        # outside the bracket: double the reach while a side is open, else halve the bracket
        fallback = F.when(gap < 0, F.when(hi >= 1e7, F.col("theta") * 2 + F.when(F.col("theta") < 0, -F.col("theta") * 1.5).otherwise(1.0)).otherwise((lo + hi) / 2)).otherwise(F.when(lo <= -1e7, F.col("theta") * 2 - F.when(F.col("theta") > 0, F.col("theta") * 1.5).otherwise(1.0)).otherwise((lo + hi) / 2))
        done = F.abs(gap) <= 1e-6 * F.greatest(F.col("target"), F.lit(1.0))
        step = state.join(sums, "skey", "left").withColumns({"words": F.coalesce("words", F.lit(0.0)), "slope": F.coalesce("slope", F.lit(0.0))})
        following = materialize(step.select("skey", "target", "scale", "source_size", F.when(done | (F.col("target") >= most * F.col("source_size")), F.when(done, F.col("theta")).otherwise(1e6)).otherwise(F.when(inside, newton).otherwise(fallback)).alias("theta"), lo.alias("lo"), hi.alias("hi"), done.alias("done")), "mix-theta")
        state = following.drop("done")
        if not following.where("not done and target < source_size * %d" % most).head(1):
            return state
    raise RuntimeError(f"no solution of the dual after {NEWTON_ROUNDS} rounds")


def _running(cells: DataFrame, value, name: str, keep=None) -> DataFrame:
    """Running sum of ``value`` by source from the largest size down, in two levels: ``name`` is the sum before the row."""
    cells = cells.withColumn("_v", value).withColumn("block", -F.floor(F.log2(F.col("size") + 1) * 8).cast("long"))
    blocks = cells.groupBy("skey", "block").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_s").over(over), F.lit(0.0))).drop("_s")
    inner = Window.partitionBy("skey", "block").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0.0))).join(blocks, ["skey", "block"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in", "block")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken."""
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    # a text key for a source that may be null
    sized = sized.withColumn("skey", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
    # documents are counted by hash bucket, so that no cell's ranking is one task
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(BUCKETS)).cast("int"))
    buckets = materialize(sized.groupBy("skey", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    goals = materialize(targets(buckets.groupBy("skey", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most), "mix-goals")
    cells = materialize(buckets.groupBy("skey", "size").agg(F.sum("n").alias("n")), "mix-hist")
    theta = _solve(cells, goals, most)

    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("theta") * F.col("size") / F.col("scale"), F.lit(5.0)))))
    rated = cells.join(theta.select("skey", "theta", "scale"), "skey").withColumn("rate", rate)
    summed = _running(rated, F.col("n") * F.col("rate"), "before")
    whole = (F.floor(F.col("before") + F.col("n") * F.col("rate") + 0.5) - F.floor(F.col("before") + 0.5)).cast("long")
    cells = materialize(summed.select("skey", "size", "n", F.least(whole, F.col("n") * most).alias("k")), "mix-copies")

    for n in range(SETTLE_ROUNDS):
        left = cells.groupBy("skey").agg(F.sum(F.col("k") * F.col("size")).alias("got")).join(goals.select("skey", "target"), "skey").select("skey", F.round(F.col("target") - F.col("got")).cast("double").alias("rest"))
        free = F.when(F.col("size") == 0, 0).when(F.col("rest") > 0, F.col("n") * most - F.col("k")).otherwise(F.col("k"))
        fits = F.when(F.col("size") > F.abs("rest"), 0).otherwise(F.col("free"))
        open_ = materialize(_running(cells.join(left, "skey").withColumn("free", free).withColumn("room", fits), F.col("room") * F.col("size") * 1.0, "before"), "mix-open")
        move = F.when(F.col("size") > 0, F.floor(F.greatest(F.lit(0.0), F.least(F.col("room") * 1.0, (F.abs("rest") - F.col("before")) / F.col("size"))))).otherwise(0)
        moved = open_.withColumn("move", move.cast("long"))
        # where nothing fits, one copy too large by less than what is missing still comes nearer
        gap = F.abs(F.col("size") - F.abs("rest"))
        near = moved.groupBy("skey").agg(F.max("move").alias("any"), F.min_by("size", F.when((F.col("free") > 0) & (gap < F.abs("rest")), F.struct(gap.alias("g"), "size"))).alias("nearest"), F.min(F.when((F.col("free") > 0) & (gap < F.abs("rest")), gap)).alias("has"))
        moved = moved.join(near, "skey").withColumn("move", F.when((F.col("any") == 0) & F.col("has").isNotNull() & (F.col("size") == F.col("nearest")), 1).otherwise(F.col("move")))
        if not moved.where("move > 0").head(1):
            break
        if n + 1 == SETTLE_ROUNDS:
            raise RuntimeError(f"the remainder isn't settled after {SETTLE_ROUNDS} rounds")
        cells = materialize(moved.select("skey", "size", "n", (F.col("k") + F.when(F.col("rest") > 0, F.col("move")).otherwise(-F.col("move"))).alias("k")), "mix-copies")

    # a cell's copies, bucket by bucket in order: every document gets the whole part, the first ones one more
    plan = cells.select("skey", "size", F.floor(F.col("k") / F.greatest("n", F.lit(1))).cast("long").alias("base"), F.expr("k % greatest(n, 1)").alias("extra"))
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    dealt = buckets.select("skey", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).join(plan, ["skey", "size"]).join(goals.select("skey", "source_size", "target"), "skey")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy(F.xxhash64("id", F.lit(23)), "id"))
    ranked = sized.withColumn("rank", rank).join(materialize(dealt, "mix-dealt"), ["skey", "size", "bucket"])
    copies = F.col("base") + F.when(F.col("rank") + F.col("ahead") <= F.col("extra"), 1).otherwise(0)
    return ranked.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
