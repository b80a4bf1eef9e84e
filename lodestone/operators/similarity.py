"""Document frequencies, weighted Jaccard, exact signatures and tiered classes of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = {"root_graph": 0, "cause_tuple": 1, "evidence": 2, "none": 3}


def document_frequency(items: DataFrame, doc: str, item: str) -> DataFrame:
    """(item, df): in how many documents each item occurs."""
    return items.select(doc, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("df"))


def set_frequency(sets: DataFrame, items: str, item: str) -> DataFrame:
    """(item, df) where each row holds one document's items in an array: repeats go before the shuffle."""
    return sets.select(F.explode(F.array_distinct(items)).alias(item)).groupBy(item).agg(F.count(F.lit(1)).alias("df"))


def idf(frequencies: DataFrame, documents: int | Column) -> DataFrame:
    """Adds ``weight`` = ln(1 + documents / df)."""
    n = documents if isinstance(documents, Column) else F.lit(documents)
    return frequencies.where("df > 0").withColumn("weight", F.log1p(F.greatest(n, F.lit(1)) / F.col("df")))


def jaccard(a: Column, b: Column) -> Column:
    """Plain Jaccard of two sets (arrays): both empty 1, one empty 0."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, 1.0).otherwise(both / F.greatest(any_, F.lit(1)))


def weighted_pairs(items: DataFrame, doc: str, item: str, weight: str, blocks: DataFrame, block: str) -> DataFrame:
    """(left, right, score): weighted Jaccard of the documents that share a block.

    ``items`` (doc, item, weight) are distinct; ``blocks`` (doc, block) chooses the pairs by an
    equi-join, never a cross join.  Intersections are sums over a second equi-join on the item,
    and a union is the two totals less the intersection.
    """
    a, b = blocks.select(F.col(doc).alias("left"), block), blocks.select(F.col(doc).alias("right"), block)
    pairs = a.join(b, block).where(F.col("left") < F.col("right")).select("left", "right").distinct()
    totals = items.groupBy(doc).agg(F.sum(weight).alias("total"))
    left = items.select(F.col(doc).alias("left"), F.col(item), F.col(weight).alias("w"))
    right = items.select(F.col(doc).alias("right"), F.col(item))
    shared = pairs.join(left, "left").join(right, ["right", item]).groupBy("left", "right").agg(F.sum("w").alias("both"))
    out = pairs.join(shared, ["left", "right"], "left").join(totals.select(F.col(doc).alias("left"), F.col("total").alias("tl")), "left", "left").join(totals.select(F.col(doc).alias("right"), F.col("total").alias("tr")), "right", "left")
    tl, tr, both = F.coalesce("tl", F.lit(0.0)), F.coalesce("tr", F.lit(0.0)), F.coalesce("both", F.lit(0.0))
    union = tl + tr - both
    score = F.when(F.col("tl").isNull() & F.col("tr").isNull(), 1.0).when(union <= 0, 0.0).otherwise(both / union)
    return out.select("left", "right", score.alias("score"))


#: Sets of so many items or fewer are compared within the join; larger ones are read again for it.
CARRIED = 64


def similar_pairs(items: DataFrame, doc: str, item: str, weight: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every pair of classes whose weighted Jaccard is ``least`` or more, and who is in which class.

    ``items`` (doc, item, weight) are distinct, an item's weight is the same everywhere.  Documents with equal items are one class,
    named after its least document; ``members``: (doc, class).  ``pairs``: (left, right, score, shared: how many items).

    No pair is lost: of two similar sets' items, heaviest first, the first common one comes before what is left weighs less than
    ``least`` of either whole, so only those leading items are joined.  They carry what comes after them: all that two sets share
    comes at or after their first common item, so the join itself knows the score, and no pair below ``least`` leaves it.
    Of pairs with a set of more than ``CARRIED`` items, for which that would be too much, the join knows bounds only; what
    remains of them is compared whole.
    """
    from ..sources.scratch import materialize, tidy

    spark = items.sparkSession
    entry = F.struct((-F.col(weight)).alias("w"), F.col(item).alias("item"))
    sets = materialize(items.groupBy(doc).agg(F.sort_array(F.collect_list(entry)).alias("items"), F.sum(weight).alias("total")))
    tidy(spark)
    named = sets.select(doc, F.unhex(F.sha2(F.to_json(F.transform("items", lambda x: x["item"])), 256)).alias("_set"))
    classes = named.groupBy("_set").agg(F.min(doc).alias("class"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    others = materialize(named.join(classes.select("_set", "class"), "_set").where(F.col(doc) != F.col("class")).select(doc, "class"))
    tidy(spark)
    heads = sets.join(others.select(doc), doc, "left_anti")
    members = heads.select(doc, F.col(doc).alias("class")).unionByName(others)
    large = F.size("items") > CARRIED
    pairs = _carried_pairs(heads.where(~large), doc, least)
    if not sets.where(large).isEmpty():
        pairs = pairs.unionByName(_large_pairs(materialize(heads), doc, least))
    return pairs, members


#: A little more than needed, so that rounding loses nothing.
SLACK = 1e-9


def _carried_pairs(heads: DataFrame, doc: str, least: float) -> DataFrame:
    """The pairs of sets whose items after a leading one go with it through the join."""
    after = lambda x, i: F.struct(x["item"].alias("item"), (-x["w"]).alias("w"), F.slice("items", i + 2, F.size("items")).alias("tail"))
    whole = lambda x: F.aggregate(x["tail"], x["w"], lambda n, t: n - t["w"])
    leading = F.filter(F.transform("items", after), lambda x: whole(x) >= F.col("total") * least - SLACK)
    each = heads.select(doc, "total", F.explode(leading).alias("x"))
    led = each.select(doc, "total", "x.item", "x.w", F.transform("x.tail", lambda t: t["item"]).alias("items"), F.transform("x.tail", lambda t: -t["w"]).alias("weights"))
    a, b = led.alias("a"), led.alias("b")
    need = (F.col("a.total") + F.col("b.total")) * (least / (1 + least)) - SLACK
    close = F.least("a.total", "b.total") >= F.greatest("a.total", "b.total") * least - SLACK
    may = close & ((F.col("a.w") >= need) | F.arrays_overlap("a.items", "b.items"))
    met = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col(f"a.{doc}") < F.col(f"b.{doc}")) & may)
    common = F.filter(F.zip_with("a.items", "a.weights", lambda i, w: F.struct(i.alias("item"), w.alias("w"))), lambda x: F.array_contains(F.col("b.items"), x["item"]))
    told = met.select(F.col(f"a.{doc}").alias("left"), F.col(f"b.{doc}").alias("right"), (F.col("a.total") + F.col("b.total")).alias("all"), F.col("a.w").alias("w"), common.alias("common"))
    both = told.select("left", "right", "all", F.aggregate("common", F.col("w"), lambda n, x: n + x["w"]).alias("both"), (F.size("common") + 1).alias("shared"))
    scored = both.select("left", "right", (F.col("both") / (F.col("all") - F.col("both"))).alias("score"), "shared").where(F.col("score") >= least)
    # a pair is met at each of its common items; at the first one all of them count
    return scored.groupBy("left", "right").agg(F.max("score").alias("score"), F.max("shared").alias("shared"))


def _large_pairs(heads: DataFrame, doc: str, least: float) -> DataFrame:
    """The pairs with a set too large to go with its leading items."""
    from ..sources.scratch import materialize

    each = heads.select(doc, "total", (F.size("items") > CARRIED).alias("large"), F.posexplode("items").alias("at", "x"))
    before = F.coalesce(F.sum(-F.col("x.w")).over(Window.partitionBy(doc).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    led = each.select(doc, "total", "large", F.col("x.item").alias("item"), (F.col("total") - before).alias("rest")).where(F.col("rest") >= F.col("total") * least - SLACK)
    led = materialize(led)
    a, b = led.alias("a"), led.alias("b")
    need = (F.col("a.total") + F.col("b.total")) * (least / (1 + least)) - SLACK
    may = (F.col("a.large") | F.col("b.large")) & (F.least("a.rest", "b.rest") >= need) & (F.least("a.total", "b.total") >= F.greatest("a.total", "b.total") * least - SLACK)
    pairs = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col(f"a.{doc}") < F.col(f"b.{doc}")) & may).select(F.col(f"a.{doc}").alias("left"), F.col(f"b.{doc}").alias("right")).distinct()
    side = lambda name: heads.select(F.col(doc).alias(name), F.struct("items", "total").alias(f"_{name}"))
    common = F.array_intersect("_left.items", "_right.items")
    told = pairs.join(side("left"), "left").join(side("right"), "right").select("left", "right", (F.col("_left.total") + F.col("_right.total")).alias("both"), common.alias("common"))
    weight_of = F.aggregate("common", F.lit(0.0), lambda n, x: n - x["w"])
    scored = told.select("left", "right", "both", F.size("common").alias("shared"), weight_of.alias("w"))
    return scored.select("left", "right", (F.col("w") / (F.col("both") - F.col("w"))).alias("score"), "shared").where(F.col("score") >= least)


def verdict(same_graph: Column, same_cause: Column, shared: Column, has_evidence: Column, score: Column, least_shared: int = 1, low: float = 0.55, high: float = 0.80) -> Column:
    """struct<duplicate, tier, score, ambiguous>: each tier only where the one before says nothing."""
    make = lambda dup, tier, s=None, amb=False: F.struct(F.lit(dup).alias("duplicate"), F.lit(tier).alias("tier"), (F.lit(None).cast("double") if s is None else s).alias("score"), F.lit(amb).alias("ambiguous"))
    zero = F.lit(0.0)
    return (
        F.when(F.coalesce(same_graph, F.lit(False)), make(True, 0))
        .when(F.coalesce(same_cause, F.lit(False)), make(True, 1))
        .when(shared < least_shared, make(False, 3, zero))
        .when(~has_evidence, make(False, 3, zero))
        .when(score >= high, make(True, 2, score))
        .when(score < low, make(False, 2, score))
        .otherwise(make(False, 2, score, True))
    )


def phase_band(phase: Column) -> Column:
    return F.when(phase < 70, 0).when(phase <= 75, 1).otherwise(2)


def cause_digest(cause: Column, roots: Column, phase: Column) -> Column:
    return F.sha2(F.concat_ws("\n", cause, F.array_join(F.array_sort(roots), ","), phase_band(phase).cast("string")), 256)


def clusters(signatures: DataFrame, key: str = "run_key", precise: str = "root_graph", coarse: str = "cause_tuple", order: str | None = None, most: int = 500) -> DataFrame:
    """Members of classes of duplicates: (cluster, key, tier, joined_tier, member_count, canonical).

    Runs with the same precise signature form a class.  A coarse bucket extends the one class
    its members touch, forms a new one where it touches none, and is dropped where it touches
    two or more.  A run has one value per column, so buckets are disjoint and all of this is
    set-based: three aggregations, no pairs.  ``canonical`` is the least by ``order`` (the key
    itself by default).  Classes over ``most`` members are left out.
    """
    from ..sources.scratch import materialize

    # read again below: the signatures are worked out once
    rows = materialize(signatures.select(F.col(key).alias("k"), F.col(precise).cast("string").alias("p"), F.col(coarse).cast("string").alias("c"), F.col(order or key).alias("o")))
    first = rows.where("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("p", F.lit(True).alias("owned"))
    tagged = rows.join(first, "p", "left").select("k", "c", "o", F.when(F.col("owned"), F.concat(F.lit("0:"), "p")).alias("cluster"))
    return placed(materialize(tagged), key, most)


def placed(tagged: DataFrame, key: str, most: int = 500) -> DataFrame:
    """Classes of (k, c, o, cluster), where the precise class is known (null: none): coarse buckets extend, form, or are dropped."""
    buckets = tagged.where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("n >= 2 and (low is null or low = high)")
    to = buckets.select("c", F.coalesce("low", F.concat(F.lit("1:"), "c")).alias("to"))
    joined = tagged.join(to, "c", "left").select("k", "o", F.coalesce("cluster", "to").alias("cluster"), F.col("cluster").isNull().cast("int").alias("joined_tier"))
    members = joined.where("cluster is not null")
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("member_count"), F.min(F.struct("o", "k")).alias("least")).where((F.col("member_count") >= 2) & (F.col("member_count") <= most))
    return members.join(size, "cluster").select("cluster", F.col("k").alias(key), F.substring("cluster", 1, 1).cast("int").alias("tier"), "joined_tier", "member_count", F.col("least.k").alias("canonical"))


def summarise(members: DataFrame) -> DataFrame:
    """One row: classes, duplicates, the largest, and classes by tier."""
    each = members.select("cluster", "tier", "member_count").distinct()
    return each.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum(F.col("member_count") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.max("member_count"), F.lit(0)).alias("largest"), F.count_if(F.col("tier") == 0).alias("tier_0"), F.count_if(F.col("tier") == 1).alias("tier_1"))


def unresolved(signatures: DataFrame, precise: str = "root_graph", coarse: str = "cause_tuple") -> DataFrame:
    """Runs with neither signature."""
    return signatures.where(F.col(precise).isNull() & F.col(coarse).isNull())


def policy_drift(members: DataFrame, facts: DataFrame, key: str = "run_key", policy: tuple[str, ...] = ("tool_version", "rules_digest")) -> DataFrame:
    """Classes whose members were diagnosed under more than one non-empty policy."""
    stamped = facts.where(" and ".join(f"coalesce({c}, '') <> ''" for c in policy))
    return members.join(stamped, key).groupBy("cluster").agg(F.countDistinct(F.struct(*policy)).alias("policies")).where("policies > 1")
