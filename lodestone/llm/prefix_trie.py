"""The trie of conversations' prefixes: which conversations share their first turns, and what keeping shared turns once saves.

A node of depth d is a distinct sequence of the first d turns (role, text) of some conversation.

* **Turns in place.**  Rows are sorted by (conversation, turn) in ranges, counted within each range, and a range's first
  conversation goes on from the ranges before it: no task needs all turns of a conversation.
* **Keys that add up.**  A turn's key is a hash of its place and content, a prefix's is the exclusive or of its turns'
  (128 bits).  So a block's key needs no order, and a prefix's key is a running sum, taken in two levels.
* **Blocks first.**  Conversations are grouped by their prefixes at multiples of ``BLOCK`` turns and the block that follows:
  one row for all conversations with the same block after the same prefix, with their number and least id.
* **Turn boundaries only where blocks part.**  A block without siblings is a chain whose nodes all have the block's
  members; they are written out from its least conversation's turns.  Blocks that differ after the same prefix (also where one ends
  sooner) are broken into their turns' prefixes, and these are grouped, one row a distinct block.
* **Sums over subtrees** without walking the tree.  A node is owned by its least conversation; a conversation owns a run of
  nodes down to its end.  A subtree's sum is the sum, over its members, of what they own in all, but for the node's
  owner, of whom only what lies below the node counts; so it takes one more grouping by blocks, and running sums along each owner.
* A node's conversations that end there are put in order by a range sort, joined piece by piece, and digested as a stream.

Defined results.  Rows go in the order of turn (null first), ties by the md5 of role and text; repeated rows are repeated turns.
Null role or text counts as empty.  Rows without a conversation id belong to none and are left out.  Negative ids: ``%`` keeps the
sign of the id.  Texts count by their UTF-8 bytes, however long; only their digests travel.  An empty table has no node, not even a
root.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, by_value, discard, materialize

#: Turns of a block; blocks, and nodes, that a running sum takes in one go; bytes of a piece of joined ids.
BLOCK, RUN, PIECE = 4, 512, 1 << 16
KEY = ("k1", "k2")


def numbered(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, content, bytes): each conversation's turns, counted from 0."""
    spark = turns.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    content = F.md5(F.concat(role, F.lit("\0"), text))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), content.alias("content"), F.octet_length(text).cast("long").alias("bytes"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("content")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, done = None, 0
        for pdf in batches:
            at = pdf.groupby("conv").cumcount()
            if last is not None:
                at = at.where(pdf["conv"] != last, at + done)
            if len(pdf):
                last, done = pdf["conv"].iloc[-1], int(at.iloc[-1]) + 1
            yield pdf.assign(at=at)

    kind = "conv long, content string, bytes long, at long"
    placed = materialize(ranged.select("conv", "content", "bytes").mapInPandas(count, kind).withColumn("part", F.spark_partition_id()), "trie-placed")
    parts = placed.groupBy("conv", "part").agg((F.max("at") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = parts.select("conv", "part", before.alias("before")).where("before > 0")  # at most one a part: its first conversation
    return placed.join(F.broadcast(later), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "content", "bytes")


def hashed(turns: DataFrame) -> DataFrame:
    """(conv, pos, k1, k2, bytes): keys of the turns in their places."""
    return turns.select("conv", "pos", *[F.xxhash64(F.lit(seed), F.col("pos").cast("long"), F.col("content")).alias(k) for seed, k in zip((31, 71), KEY, strict=True)], "bytes")


def _running(rows: DataFrame, by: str, at: str, sums: dict[str, tuple], *, down: bool = False) -> DataFrame:
    """Running sums along ``by`` in the order of ``at``, a row's own included, in two levels; sums: name to (aggregate, column, how to join two)."""
    part = (F.col(at) / RUN).cast("long")
    order = F.col(at).desc() if down else F.col(at)
    own = Window.partitionBy(by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("_run", part)
    told = told.select("*", *[f(F.col(c)).over(own).alias(f"_{name}") for name, (f, c, _) in sums.items()])
    runs = rows.withColumn("_run", part).groupBy(by, "_run").agg(*[f(F.col(c)).alias(f"_all_{name}") for name, (f, c, _) in sums.items()])
    before = Window.partitionBy(by).orderBy(F.col("_run").desc() if down else F.col("_run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(by, "_run", *[f(F.col(f"_all_{name}")).over(before).alias(f"_before_{name}") for name, (f, _, _) in sums.items()])
    joined = told.join(runs, [by, "_run"])
    return joined.select(*rows.columns, *[join(F.col(f"_{name}"), F.coalesce(f"_before_{name}", F.lit(0).cast("long"))).alias(name) for name, (_, _, join) in sums.items()])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _digests(ends: DataFrame) -> DataFrame:
    """(node columns, ends_sha256) of (depth, k1, k2, conv): the ids in ascending order, joined by commas."""
    spark = ends.sparkSession
    bound_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    node = ["depth", *KEY]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, size, out = None, [], 0, []
        for pdf in batches:
            for *key, conv in zip(*(pdf[c].tolist() for c in (*node, "conv")), strict=True):
                if ids and (key != held or size >= PIECE):
                    out.append((*held, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                held = key
                ids.append(conv)
                size += 20
            yield pd.DataFrame(out, columns=[*node, "first", "ids"])
            out = []
        if ids:
            yield pd.DataFrame([(*held, ids[0], ",".join(map(str, ids)))], columns=[*node, "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, out = None, None, []
        for pdf in batches:
            for *key, ids in zip(*(pdf[c].tolist() for c in (*node, "ids")), strict=True):
                if key != held:
                    if state:
                        out.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*node, "ends_sha256"])
            out = []
        if state:
            yield pd.DataFrame([(*held, state.hexdigest())], columns=[*node, "ends_sha256"])

    kind = "depth long, k1 long, k2 long"
    joined = ends.repartitionByRange(n, *node, "conv").sortWithinPartitions(*node, "conv").mapInPandas(pieces, f"{kind}, first long, ids string")
    return joined.repartition(n, *node).sortWithinPartitions(*node, "first").mapInPandas(digest, f"{kind}, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Nodes of conversations given as (conv, pos, k1, k2, bytes); ``convs`` (conv): all of them, with those that have no turn.

    Gives conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 a node.
    """
    turns = materialize(turns.select("conv", F.col("pos").cast("long").alias("pos"), *KEY, "bytes"), "trie-turns")
    convs = turns.select("conv").distinct() if convs is None else convs
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    blocks = turns.groupBy("conv", block.alias("block")).agg(*[F.bit_xor(k).alias(f"own_{k}") for k in KEY], F.count(F.lit(1)).alias("turns"))
    chained = _running(blocks, "conv", "block", {k: (F.bit_xor, f"own_{k}", _xor) for k in KEY})
    # (conv, block, turns, k1, k2: after it, p1, p2: before it)
    chained = materialize(chained.select("conv", "block", "turns", *KEY, *[F.col(k).bitwiseXOR(F.col(f"own_{k}")).alias(p) for k, p in zip(KEY, ("p1", "p2"), strict=True)]), "trie-blocks")

    # blocks: one row for all conversations with the same block after the same prefix
    edge = ["block", "p1", "p2", *KEY]
    distinct = materialize(chained.groupBy(*edge).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")), "trie-distinct")
    parted = distinct.groupBy("block", "p1", "p2").count().where("count > 1").select("block", "p1", "p2", F.lit(True).alias("parts"))
    marked = distinct.join(parted, ["block", "p1", "p2"], "left").select(*edge, "conv", "n", F.coalesce("parts", F.lit(False)).alias("parts"))
    # their turns' prefixes, from the least conversation that has the block
    along = Window.partitionBy("block", "p1", "p2", "e1", "e2").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumnsRenamed({"k1": "e1", "k2": "e2"}).join(turns.withColumn("block", block), ["conv", "block"])
    keys = [F.bit_xor(k).over(along).bitwiseXOR(F.col(p)).alias(k) for k, p in zip(KEY, ("p1", "p2"), strict=True)]
    told = inside.select("conv", "n", "parts", "bytes", F.col("pos"), *keys, *[F.col(k).alias(f"turn_{k}") for k in KEY], "block", "e1", "e2", "p1", "p2")
    steps = told.select(
        (F.col("pos") + 1).alias("depth"), *KEY, *[F.col(k).bitwiseXOR(F.col(f"turn_{k}")).alias(f"parent_{k}") for k in KEY], "conv", "n", "bytes", "parts",
        "block", "p1", "p2", "e1", "e2",
    )
    steps = materialize(steps, "trie-steps")
    node = ["depth", *KEY]
    group = [*node, "parent_k1", "parent_k2"]
    chains = steps.where("not parts").select(*group, "conv", "n", "bytes")
    grouped = steps.where("parts").groupBy(*group).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.min("bytes").alias("bytes"))
    nodes = chains.unionByName(grouped)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0").select(zero.alias("depth"), *[zero.alias(k) for k in (*KEY, "parent_k1", "parent_k2")], "conv", "n", zero.alias("bytes"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"parent_{k}").alias(k) for k in KEY]).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.unionByName(root).join(children, node, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialize(nodes.withColumn("saves", (F.col("n") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-nodes")

    # what each conversation owns in all, summed over the members of every block, then of every node
    owned = materialize(nodes.groupBy("conv").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf")), "trie-owned")
    totals = ["saves", "leaf"]
    by_block = chained.select("conv", *edge).join(owned, "conv").groupBy(*edge).agg(*[F.sum(c).alias(c) for c in totals])
    summed = steps.select(*node, "parts", "block", "p1", "p2", "e1", "e2").join(by_block.withColumnsRenamed({"k1": "e1", "k2": "e2"}), ["block", "p1", "p2", "e1", "e2"])
    members = summed.where("not parts").select(*node, *totals).unionByName(summed.where("parts").groupBy(*node).agg(*[F.sum(c).alias(c) for c in totals]))
    members = members.unionByName(owned.agg(*[F.sum(c).alias(c) for c in totals]).where("leaf is not null").select(zero.alias("depth"), *[zero.alias(k) for k in KEY], *totals))
    below = _running(nodes.select("conv", "depth", *KEY, "saves"), "conv", "depth", {"below": (F.sum, "saves", _plus)}, down=True).select(*node, "below")
    all_own = owned.select("conv", F.col("saves").alias("all_own"))
    sums = members.join(below, node)

    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"), *[F.bit_xor(k).alias(k) for k in KEY])
    ends = convs.join(lengths, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in node])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"parent_{k}") for k in KEY], F.col("conv").alias("parent_conv_id"))
    found = nodes.join(sums.withColumnRenamed("saves", "of_members").withColumnRenamed("leaf", "leaves"), node).join(all_own, "conv")
    found = found.join(parents, ["depth", "parent_k1", "parent_k2"], "left").join(_digests(ends), node, "left")
    found = found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("of_members") - F.col("all_own") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    out = materialize(found, "trie")
    for done in (turns, chained, distinct, steps, nodes, owned):
        discard(done)
    return out


def with_shared_openings(turns: DataFrame, opening: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): of numbered turns, every conversation with its first ``opening`` turns replaced by those of conversation ``base``.

    Both columns are of ``conv``.  Where the base has fewer turns, all it has; where it has none, none; own turns after ``opening`` follow.
    """
    turns = materialize(turns, "trie-numbered")
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", opening.cast("long").alias("opening"), base.alias("base"))
    wanted = lengths.select("conv", "opening", "base")
    most = lengths.agg(F.max("opening")).first()[0] or 0
    first = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "content", "bytes")
    opened = first.join(wanted, "base").where("pos < opening").select("conv", "pos", "content", "bytes")
    base_n = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = wanted.join(base_n, "base", "left").select("conv", "opening", F.least(F.coalesce("base_n", F.lit(0)), "opening").alias("taken"))
    rest = turns.join(taken, "conv").where("pos >= opening").select("conv", (F.col("pos") - F.col("opening") + F.col("taken")).alias("pos"), "content", "bytes")
    return opened.unionByName(rest), lengths.select("conv")


by_value(__name__)
